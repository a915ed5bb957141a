"""linkblocks: entity-resolution blocking and corpus preparation on Spark."""

__version__ = "0.1.0"

"""Blocks by key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..blocks import BlockSet
from ..functions import text as X
from ..functions.lineage import settled
from ..model import EntityFrame
from .base import Blocker


class StandardBlocker(Blocker):
    """Entities with one value of the key column are a block."""

    def __init__(self, blocking_key: str):
        self.blocking_key = blocking_key

    def keys(self, side: EntityFrame) -> DataFrame:
        key = F.col(f"`{self.blocking_key}`").cast("string")
        return side.df.select(key.alias("block_id"), F.col(f"`{side.id_col}`").alias("entity_id")).where("block_id is not null")

    def assign(self, left, right, left_rel=None, right_rel=None) -> BlockSet:
        return BlockSet(self.keys(left), self.keys(right), left.name, right.name)


class QgramsBlocker(StandardBlocker):
    """Entities that share a substring of q characters of the key column are a block."""

    def __init__(self, blocking_key: str, q: int = 3):
        super().__init__(blocking_key)
        self.q = q

    def keys(self, side: EntityFrame) -> DataFrame:
        grams: Column = X.qgrams(F.col(f"`{self.blocking_key}`").cast("string"), self.q)
        return side.df.select(F.explode(grams).alias("block_id"), F.col(f"`{side.id_col}`").alias("entity_id"))


class SortedNeighborhoodBlocker(StandardBlocker):
    """Both sides sorted by the key together; every ``window`` neighbours are a block.

    Rows are dealt to tasks by ranges of key, side and id, ranked within a range and
    offset by the sizes of the ranges before it, so no task sorts all rows, whatever
    keys they have. The ranges are settled once: they must not be drawn anew.
    """

    def __init__(self, blocking_key: str, window: int = 3):
        super().__init__(blocking_key)
        self.window = window

    def assign(self, left, right, left_rel=None, right_rel=None) -> BlockSet:
        tagged = lambda s, side: self.keys(s).withColumn("side", F.lit(side))
        order = ["block_id", "side", "entity_id"]
        rows = tagged(left, 0).unionByName(tagged(right, 1)).withColumn("entity_id", F.col("entity_id").cast("string"))
        rows = settled(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
        # one row a range
        sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
        offset = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
        rank = F.row_number().over(Window.partitionBy("part").orderBy(*order))
        placed = rows.withColumn("rank", rank).join(F.broadcast(offset), "part").select("side", "entity_id", (F.col("rank") + F.col("offset")).alias("at"))
        starts = F.sequence(F.greatest(F.col("at") - self.window + 1, F.lit(1).cast("long")), F.col("at"))
        member = placed.select("side", "entity_id", F.explode(starts).alias("block_id"))
        side = lambda k: member.where(F.col("side") == k).select("block_id", "entity_id")
        return BlockSet(side(0), side(1), left.name, right.name)

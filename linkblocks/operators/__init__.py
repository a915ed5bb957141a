"""Blocking operators. Each has ``assign(left, right, left_rel=None, right_rel=None)``."""

from .base import Blocker, TextBlocker
from .clustering import AttributeClusteringLSHBlocker, AttributeClusteringTokenBlocker, TokenClusteringLSHBlocker, TokenClusteringTokenBlocker
from .composite import (
    CompositeAttributeClusteringBlocker,
    CompositeAttributeClusteringLSHBlocker,
    CompositeDeepBlocker,
    CompositeEmbeddingBlocker,
    CompositeLightEABlocker,
    CompositeRelationalTokenBlocker,
    CompositeTokenClusteringBlocker,
    CompositeTokenClusteringLSHBlocker,
    CompositeUniqueNameBlocker,
)
from .embedding import DeepBlocker, EmbeddingBlocker
from .lsh import MinHashLSHBlocker
from .relational import (
    RelationalDeepBlocker,
    RelationalLSHBlocker,
    RelationalTokenAttributeBlocker,
    RelationalTokenBlocker,
    SimpleRelationalLSHBlocker,
    SimpleRelationalTokenBlocker,
)
from .standard import QgramsBlocker, SortedNeighborhoodBlocker, StandardBlocker
from .token import PartitioningTokenBlocker, TfIdfTokenBlocker, TokenBlocker, UniqueNameBlocker

__all__ = [n for n in dir() if n.endswith("Blocker")]

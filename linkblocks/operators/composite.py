"""Unique names first, then other blockers for the entities that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..blocks import combine_blocks
from ..functions.text import Tokenizer
from ..model import EntityFrame
from ..vectors.encoders import LightEAEncoder
from ..vectors.knn import builder
from .base import Blocker, TextBlocker
from .clustering import AttributeClusteringLSHBlocker, AttributeClusteringTokenBlocker, TokenClusteringLSHBlocker, TokenClusteringTokenBlocker
from .embedding import DeepBlocker, EmbeddingBlocker
from .graph import neighbor_texts, neighbor_values
from .relational import _need
from .token import TokenBlocker, UniqueNameBlocker


def without_matched(rows: DataFrame, members: DataFrame, col: str = "id") -> DataFrame:
    """Rows whose id is in no block of members (block_id, entity_id)."""
    done = members.select(F.col("entity_id").alias("_done")).distinct()
    return rows.join(done, rows[col].cast("string") == done["_done"], "left_anti")


class CompositeUniqueNameBlocker(Blocker):
    """Unique-name blocks, an attribute blocker and a blocker of neighbours' text on the rest; all combined."""

    def __init__(self, attributes: TextBlocker | None = None, relations=None, top_n_a: int | None = None, top_n_r: int | None = None, use_unique: bool = True):
        self.attributes, self.relations = attributes, relations
        self.top_n_a, self.top_n_r, self.use_unique = top_n_a, top_n_r, use_unique

    def relation_blocks(self, left, right, left_rel, right_rel, rest):
        texts = [rest(neighbor_texts(f, r, True, self.top_n_a, self.top_n_r), k) for k, (f, r) in enumerate(((left, left_rel), (right, right_rel)))]
        return self.relations.assign_texts(*texts, left.name, right.name)

    def assign(self, left: EntityFrame, right: EntityFrame, left_rel=None, right_rel=None):
        _need(left_rel, right_rel)
        blocks = UniqueNameBlocker().assign(left, right).settle() if self.use_unique else None

        def rest(rows: DataFrame, side: int, col: str = "id") -> DataFrame:
            return without_matched(rows, blocks.left if side == 0 else blocks.right, col) if blocks else rows

        out = blocks
        if self.attributes:
            own = self.attributes.assign_texts(rest(left.texts(), 0), rest(right.texts(), 1), left.name, right.name)
            out = combine_blocks(out, own) if out else own
        if self.relations:
            near = self.relation_blocks(left, right, left_rel, right_rel, rest)
            out = combine_blocks(out, near) if out else near
        return out


class CompositeRelationalTokenBlocker(CompositeUniqueNameBlocker):
    """Unique names and a token blocker of own and neighbours' text."""

    def __init__(self, tokenizer: Tokenizer | None = None, min_token_length: int = 3, top_n_a=None, top_n_r=None):
        super().__init__(None, TokenBlocker(tokenizer, min_token_length), top_n_a, top_n_r)


class CompositeClusteringBlocker(CompositeUniqueNameBlocker):
    """Token blocks of own text, and clusters of neighbours' values."""

    def __init__(self, clustering, tokenizer: Tokenizer | None = None, top_n_a=None, top_n_r=None):
        super().__init__(TokenBlocker(tokenizer), clustering, top_n_a, top_n_r)

    def relation_blocks(self, left, right, left_rel, right_rel, rest):
        values = [rest(neighbor_values(f, r, True, self.top_n_a, self.top_n_r).distinct(), k, "head") for k, (f, r) in enumerate(((left, left_rel), (right, right_rel)))]
        return self.relations.assign_triples(*values, left.name, right.name)


def _composite(kind, name: str):
    def init(self, tokenizer: Tokenizer | None = None, top_n_a=None, top_n_r=None, **kw):
        CompositeClusteringBlocker.__init__(self, kind(tokenizer, **kw), tokenizer, top_n_a, top_n_r)

    return type(name, (CompositeClusteringBlocker,), {"__init__": init, "__doc__": f"Unique names, tokens, and {kind.__name__} of neighbours' values."})


CompositeAttributeClusteringBlocker = _composite(AttributeClusteringTokenBlocker, "CompositeAttributeClusteringBlocker")
CompositeTokenClusteringBlocker = _composite(TokenClusteringTokenBlocker, "CompositeTokenClusteringBlocker")
CompositeAttributeClusteringLSHBlocker = _composite(AttributeClusteringLSHBlocker, "CompositeAttributeClusteringLSHBlocker")
CompositeTokenClusteringLSHBlocker = _composite(TokenClusteringLSHBlocker, "CompositeTokenClusteringLSHBlocker")


class CompositeDeepBlocker(CompositeUniqueNameBlocker):
    """Tokens of own text and a trained encoder of neighbours' text."""

    def __init__(self, text_encoder=None, block_builder=None, tokenizer: Tokenizer | None = None, top_n_a=None, top_n_r=None, use_unique: bool = False, save_dir: str | None = None, force: bool = False):
        super().__init__(TokenBlocker(tokenizer), DeepBlocker(text_encoder, block_builder, save_dir, force), top_n_a, top_n_r, use_unique)


class CompositeEmbeddingBlocker(CompositeUniqueNameBlocker):
    """Tokens of own text and an encoder of neighbours' text."""

    def __init__(self, text_encoder=None, block_builder=None, tokenizer: Tokenizer | None = None, top_n_a=None, top_n_r=None, use_unique: bool = True, save_dir: str | None = None, force: bool = False):
        super().__init__(TokenBlocker(tokenizer), EmbeddingBlocker(text_encoder, block_builder, save_dir, force), top_n_a, top_n_r, use_unique)


class CompositeLightEABlocker(CompositeUniqueNameBlocker):
    """Tokens of own text and graph vectors: all entities are encoded, those matched by name leave before the neighbours are sought."""

    def __init__(self, graph_encoder=None, block_builder=None, tokenizer: Tokenizer | None = None, use_unique: bool = True):
        super().__init__(TokenBlocker(tokenizer), graph_encoder or LightEAEncoder(only_neighbors=True), use_unique=use_unique)
        self.builder = builder(block_builder)

    def relation_blocks(self, left, right, left_rel, right_rel, rest):
        vecs = self.relations.encode(left.texts(), right.texts(), left_rel, right_rel)
        return self.builder.build(rest(vecs[0], 0, "name"), rest(vecs[1], 1, "name"), left.name, right.name)

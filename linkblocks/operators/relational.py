"""Blocks by own text and by the text of neighbours in the relation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..blocks import BlockSet, combine_blocks
from ..functions.text import Tokenizer
from .base import Blocker, TextBlocker
from .graph import neighbor_texts, neighbor_values
from .lsh import MinHashLSHBlocker
from .token import TokenBlocker


def _need(left_rel, right_rel):
    if left_rel is None or right_rel is None:
        raise ValueError("relation triples of both sides are needed")


class SimpleRelationalBlocker(Blocker):
    """One blocker over own and neighbours' text together."""

    def __init__(self, blocker: TextBlocker, top_n_a: int | None = None, top_n_r: int | None = None):
        self.blocker, self.top_n_a, self.top_n_r = blocker, top_n_a, top_n_r

    def assign(self, left, right, left_rel=None, right_rel=None):
        _need(left_rel, right_rel)
        texts = [neighbor_texts(f, r, True, self.top_n_a, self.top_n_r) for f, r in ((left, left_rel), (right, right_rel))]
        return self.blocker.assign_texts(*texts, left.name, right.name)


class SimpleRelationalTokenBlocker(SimpleRelationalBlocker):
    def __init__(self, tokenizer: Tokenizer | None = None, min_token_length: int = 3, top_n_a=None, top_n_r=None):
        super().__init__(TokenBlocker(tokenizer, min_token_length), top_n_a, top_n_r)


class SimpleRelationalLSHBlocker(SimpleRelationalBlocker):
    def __init__(self, top_n_a=None, top_n_r=None, **lsh):
        super().__init__(MinHashLSHBlocker(**lsh), top_n_a, top_n_r)


class RelationalBlocker(Blocker):
    """Two views: blocks by own text combined with blocks by neighbours' text alone."""

    def __init__(self, attributes: TextBlocker, relations: TextBlocker, top_n_a: int | None = None, top_n_r: int | None = None):
        self.attributes, self.relations, self.top_n_a, self.top_n_r = attributes, relations, top_n_a, top_n_r

    def assign(self, left, right, left_rel=None, right_rel=None):
        _need(left_rel, right_rel)
        own = self.attributes.assign(left, right)
        texts = [neighbor_texts(f, r, False, self.top_n_a, self.top_n_r) for f, r in ((left, left_rel), (right, right_rel))]
        return combine_blocks(own, self.relations.assign_texts(*texts, left.name, right.name))


class RelationalTokenBlocker(RelationalBlocker):
    def __init__(self, tokenizer: Tokenizer | None = None, attr_min_token_length: int = 3, rel_min_token_length: int = 3, top_n_a=None, top_n_r=None):
        super().__init__(TokenBlocker(tokenizer, attr_min_token_length), TokenBlocker(tokenizer, rel_min_token_length), top_n_a, top_n_r)


class RelationalLSHBlocker(RelationalBlocker):
    def __init__(self, attr_threshold: float = 0.5, rel_threshold: float = 0.7, top_n_a=None, top_n_r=None, **lsh):
        super().__init__(MinHashLSHBlocker(threshold=attr_threshold, **lsh), MinHashLSHBlocker(threshold=rel_threshold, **lsh), top_n_a, top_n_r)


class RelationalDeepBlocker(RelationalBlocker):
    """Both views by a trained encoder; saved under attributes/ and relation/ of ``save_dir``."""

    def __init__(self, attr_encoder, rel_encoder, attr_builder=None, rel_builder=None, top_n_a=None, top_n_r=None, save_dir: str | None = None, force: bool = False):
        from .embedding import DeepBlocker

        at = lambda d: f"{save_dir.rstrip('/')}/{d}" if save_dir else None
        super().__init__(DeepBlocker(attr_encoder, attr_builder, at("attributes"), force), DeepBlocker(rel_encoder, rel_builder, at("relation"), force), top_n_a, top_n_r)


class RelationalTokenAttributeBlocker(Blocker):
    """Token blocks of own text beside blocks of equal values of neighbours; ids of the two kinds stay apart."""

    def __init__(self, tokenizer: Tokenizer | None = None, min_token_length: int = 3, top_n_a=None, top_n_r=None):
        self.tokens, self.top_n_a, self.top_n_r = TokenBlocker(tokenizer, min_token_length), top_n_a, top_n_r

    def assign(self, left, right, left_rel=None, right_rel=None) -> BlockSet:
        _need(left_rel, right_rel)
        side = lambda f, r: neighbor_values(f, r, False, self.top_n_a, self.top_n_r).select(F.col("tail").alias("block_id"), F.col("head").alias("entity_id"))
        values = BlockSet(side(left, left_rel), side(right, right_rel), left.name, right.name)
        return self.tokens.assign(left, right).concat(values, ("token:", "value:"))

"""Blocks over clusters of attribute values or of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, concat_triples, exploded_tokens
from ..model import EntityFrame, TripleFrame
from ..vectors.encoders import Encoder, encoder
from ..vectors.knn import clustered
from .base import Blocker, TextBlocker
from .lsh import MinHashLSHBlocker
from .token import TokenBlocker

PREFIX = "clustering_label_"
NOISE = ("keep", "remove", "token")


def handle_noise(labels: DataFrame, how: str = "keep", compat: bool = False) -> DataFrame:
    """(value, label) with labels as strings. ``remove`` drops noise, with ``compat`` cluster 0 too; ``token`` makes a noise value its own label."""
    if how not in NOISE:
        raise ValueError(f"noise is one of {NOISE}")
    label = F.col("label").cast("string")
    if how == "remove":
        labels = labels.where(F.col("label") > 0 if compat else F.col("label") >= 0)
    elif how == "token":
        label = F.when(F.col("label") == -1, F.col("value")).otherwise(label)
    return labels.select("value", label.alias("label"))


def labelled_texts(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text): each entity's cluster labels of its values, prefixed and joined."""
    named = labels.select(F.col("value").alias("tail"), F.concat(F.lit(PREFIX), "label").alias("label"))
    return concat_triples(triples.join(named, "tail").select("head", "relation", F.col("label").alias("tail")))


class ClusteringBlocker(Blocker):
    """Distinct values to vectors to clusters of both sides; labels stand for values in the text blocker.

    ``given``: labels (value, label) found elsewhere, such as those kept in a ``save_dir``; nothing is clustered then.
    """

    def __init__(self, blocker: TextBlocker, text_encoder: Encoder | str | None = None, noise: str = "keep", compat: bool = False, save_dir: str | None = None, given: DataFrame | None = None, **clustering):
        self.blocker, self.encoder, self.noise, self.compat, self.save_dir, self.options = blocker, encoder(text_encoder), noise, compat, save_dir, clustering
        self.given = given

    def values(self, triples: DataFrame) -> DataFrame:
        """(head, relation, tail) whose tails are clustered."""
        return triples.where("tail is not null")

    def labels(self, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        if self.given is not None:
            return (handle_noise(self.given, self.noise, self.compat),) * 2
        distinct = lambda t: t.select(F.col("tail").alias("id"), F.col("tail").alias("text")).distinct()
        vectors = self.encoder.encode(distinct(left), distinct(right))
        found = clustered(*vectors, **self.options)
        if self.save_dir:
            from ..sources.storage import save_vectors

            save_vectors(*vectors, f"{self.save_dir}/vectors")
            save_vectors(*found, f"{self.save_dir}/labels")
        return tuple(handle_noise(d.select(F.col("id").alias("value"), "label"), self.noise, self.compat) for d in found)

    def assign_triples(self, left: DataFrame, right: DataFrame, left_name="left", right_name="right"):
        a, b = self.values(left), self.values(right)
        la, lb = self.labels(a, b)
        return self.blocker.assign_texts(labelled_texts(a, la), labelled_texts(b, lb), left_name, right_name)

    def assign(self, left: EntityFrame, right: EntityFrame, left_rel=None, right_rel=None):
        return self.assign_triples(as_triples(left), as_triples(right), left.name, right.name)


def as_triples(side: EntityFrame) -> DataFrame:
    if isinstance(side, TripleFrame):
        return side.triples()
    cells = F.array(*(F.struct(F.lit(c).alias("relation"), F.col(f"`{c}`").cast("string").alias("tail")) for c in side.non_id_columns))
    return side.df.select(F.col(f"`{side.id_col}`").cast("string").alias("head"), F.explode(cells).alias("c")).select("head", "c.relation", "c.tail")


class TokenValues:
    tokenizer: Tokenizer

    def values(self, triples):
        rows = exploded_tokens(triples.where("tail is not null").select(F.struct("head", "relation").alias("id"), F.col("tail").alias("text")), self.tokenizer)
        return rows.select("id.head", "id.relation", F.col("tok").alias("tail")).distinct()


class AttributeClusteringTokenBlocker(ClusteringBlocker):
    def __init__(self, tokenizer: Tokenizer | None = None, **kw):
        super().__init__(TokenBlocker(tokenizer), **kw)


class AttributeClusteringLSHBlocker(ClusteringBlocker):
    def __init__(self, tokenizer: Tokenizer | None = None, lsh: dict | None = None, **kw):
        super().__init__(MinHashLSHBlocker(tokenizer, **(lsh or {})), **kw)


class TokenClusteringTokenBlocker(TokenValues, AttributeClusteringTokenBlocker):
    def __init__(self, tokenizer: Tokenizer | None = None, **kw):
        super().__init__(tokenizer, **kw)
        self.tokenizer = tokenizer or Tokenizer()


class TokenClusteringLSHBlocker(TokenValues, AttributeClusteringLSHBlocker):
    def __init__(self, tokenizer: Tokenizer | None = None, lsh: dict | None = None, **kw):
        super().__init__(tokenizer, lsh, **kw)
        self.tokenizer = tokenizer or Tokenizer()

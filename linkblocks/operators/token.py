"""Blocks by tokens of the text of all attributes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..blocks import BlockSet
from ..functions.counts import counted, flat, frequent, lists, repeated_ids
from ..functions.lineage import bounded, settled, stored
from ..functions.text import Tokenizer, exploded_tokens
from ..model import TripleFrame
from .base import Blocker, TextBlocker
from .partners import partner_counts


class TokenBlockSet(BlockSet):
    """Token blocks of two (id, text) frames; distinct pairs are counted without listing them."""

    def __init__(self, left, right, left_name, right_name, texts, tokenizer):
        super().__init__(left, right, left_name, right_name)
        self.texts, self.tokenizer = texts, tokenizer

    def distinct_comparisons(self) -> DataFrame:
        _, found = partner_counts(*self.texts, self.tokenizer, members=False)
        return found.agg(F.coalesce(F.sum(F.col("ids") * F.col("n")), F.lit(0)).cast("bigint").alias("comparisons"))


class PartitionBlockSet(BlockSet):
    """A block for each left entity; its right ones are counted without listing them."""

    def __init__(self, left, right, left_name, right_name, texts, tokenizer):
        super().__init__(left, right, left_name, right_name, one_sided=True)
        self.texts, self.tokenizer = texts, tokenizer

    def sizes(self) -> DataFrame:
        ids, found = partner_counts(*self.texts, self.tokenizer)
        return ids.join(found, "profile").select(F.col("id").cast("string").alias("block_id"), F.lit(1).cast("bigint").alias("n_left"), F.col("n").alias("n_right"))


class TokenBlocker(TextBlocker):
    """Entities that share a token are a block."""

    def __init__(self, tokenizer: Tokenizer | None = None, min_token_length: int = 3, stop_words=None):
        self.tokenizer = tokenizer or Tokenizer(min_token_length, stop_words)

    def assign_texts(self, left, right, left_name="left", right_name="right") -> BlockSet:
        side = lambda d: exploded_tokens(d, self.tokenizer).select(F.col("tok").alias("block_id"), F.col("id").alias("entity_id"))
        return TokenBlockSet(side(left), side(right), left_name, right_name, (left, right), self.tokenizer)


def unique_values(triples: DataFrame) -> DataFrame:
    """(tail, head) of values that belong to one head only."""
    one = triples.where("tail is not null").groupBy("tail").agg(F.min("head").alias("head"), F.max("head").alias("last"))
    return one.where("head = last").select("tail", "head")


class UniqueNameBlocker(Blocker):
    """One block of two entities for each value that exactly one entity of either side has."""

    def assign(self, left: TripleFrame, right: TripleFrame, left_rel=None, right_rel=None) -> BlockSet:
        if left.df.columns != right.df.columns:
            raise ValueError("the tables have different columns")
        side = lambda f: unique_values(f.triples()).select(F.concat(F.lit("unique_"), "tail").alias("block_id"), F.col("head").alias("entity_id"))
        return BlockSet(side(left), side(right), left.name, right.name, distinct=False)._closed()


class PartitioningTokenBlocker(TextBlocker):
    """For each left entity all right ones that share a token with it: the token pairs without duplicates."""

    def __init__(self, tokenizer: Tokenizer | None = None):
        self.tokenizer = tokenizer or Tokenizer()

    def assign_texts(self, left, right, left_name="left", right_name="right") -> BlockSet:
        a = exploded_tokens(left, self.tokenizer)
        b = exploded_tokens(right, self.tokenizer).withColumnRenamed("id", "right_id")
        pairs = a.join(b, "tok").select("id", "right_id").distinct()
        own = left.select(F.col("id").alias("block_id"), F.col("id").alias("entity_id"))
        # a left entity without a partner keeps its block, empty on the right
        return PartitionBlockSet(own, pairs.select(F.col("id").alias("block_id"), F.col("right_id").alias("entity_id")), left_name, right_name, (left, right), self.tokenizer)


def tfidf_weights(texts: DataFrame, tokenizer: Tokenizer, norm: str | None = "l2", use_idf: bool = True, smooth_idf: bool = True, sublinear_tf: bool = False) -> DataFrame:
    """(id, tok, weight) over (id, text) as one corpus."""
    if norm not in ("l1", "l2", None):
        raise ValueError("norm is l1, l2 or None")
    tf = exploded_tokens(texts, tokenizer, distinct=False).groupBy("id", "tok").agg(F.count("*").alias("n"))
    w = F.log(F.col("n").cast("double")) + 1 if sublinear_tf else F.col("n").cast("double")
    if use_idf:
        df = tf.groupBy("tok").agg(F.count("*").alias("df"))
        total = F.broadcast(texts.agg(F.count_distinct("id").alias("total")))
        add = 1.0 if smooth_idf else 0.0
        tf = tf.join(df, "tok").crossJoin(total)
        w = w * (F.log((F.col("total") + add) / (F.col("df") + add)) + 1)
    rows = tf.select("id", "tok", w.alias("w"))
    if norm is None:
        return rows.withColumnRenamed("w", "weight")
    over = Window.partitionBy("id")
    size = F.sum(F.abs("w")).over(over) if norm == "l1" else F.sqrt(F.sum(F.col("w") * F.col("w")).over(over))
    return rows.select("id", "tok", (F.col("w") / size).alias("weight"))


class DealtBlockSet(BlockSet):
    """Blocks of very different sizes: the pairs of a large one are made by several tasks."""

    def pairs(self) -> DataFrame:
        parts = F.ceil(F.col("n_left") * F.col("n_right") / F.lit(PART)).cast("int")
        sizes = settled(self.sizes().select("block_id", parts.alias("parts")))
        # small in bytes, parts would be put together to a few tasks
        large = sizes.where("parts > 1").agg(F.sum("parts")).first()[0] or 0
        tasks = min(2000, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 2 * large)
        sizes = bounded(sizes)
        left = self.left.join(sizes, "block_id").select("block_id", F.pmod(F.xxhash64("entity_id"), "parts").cast("int").alias("part"), F.col("entity_id").alias("left_id"))
        right = self.right.join(sizes, "block_id").select("block_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("entity_id").alias("right_id"))
        dealt = lambda d: d.repartition(tasks, "block_id", "part")
        return dealt(left).join(dealt(right), ["block_id", "part"]).drop("part")


#: Pairs of a block that one task makes, about.
PART = 1 << 21


class TfIdfTokenBlocker(TextBlocker):
    """Token blocks of the tokens whose tf-idf weight reaches the threshold; at 0 or less all tokens count."""

    def __init__(self, threshold: float, tokenizer: Tokenizer | None = None, **options):
        self.threshold, self.tokenizer, self.options = threshold, tokenizer or Tokenizer(), options

    def assign_texts(self, left, right, left_name="left", right_name="right") -> BlockSet:
        if self.threshold <= 0:
            return TokenBlocker(self.tokenizer).assign_texts(left, right, left_name, right_name)
        # one corpus, whose sides may share ids
        tag = lambda d, s: d.select(F.struct(F.lit(s).alias("s"), F.col("id").alias("i")).alias("id"), "text")
        texts = tag(left, 0).unionByName(tag(right, 1))
        if repeated_ids(texts):
            kept = settled(tfidf_weights(texts, self.tokenizer, **self.options).where(F.col("weight") >= self.threshold))
        else:
            kept = settled(heavy_tokens(texts, self.tokenizer, self.threshold, **self.options))
        side = lambda s: kept.where(F.col("id.s") == s).select(F.col("tok").alias("block_id"), F.col("id.i").alias("entity_id"))
        return DealtBlockSet(side(0), side(1), left_name, right_name, distinct=False)


def _split(given, total: int, threshold: float, norm: str | None, use_idf: bool, add: float, sublinear: bool):
    """Of each text the summed size of its frequent tokens, those of them that can reach the threshold, and its other tokens."""
    def run(batches):
        known, df = given.value
        for b in batches:
            col = lambda n: b.column(b.schema.get_field_index(n))  # noqa: B023, E731
            toks, row = flat(col("toks"))
            n = col("ns").flatten().to_numpy(zero_copy_only=False).astype(float)
            at = pc.index_in(toks, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            there = at >= 0
            w = np.log(n) + 1 if sublinear else n
            if use_idf:
                w = w * (np.log((total + add) / (df[at] + add)) + 1)
            part = np.where(there, w * w if norm == "l2" else w, 0.0)
            size = np.bincount(row, part, minlength=b.num_rows)
            # the other tokens can only lower a weight
            least = {"l2": np.sqrt(size), "l1": size, None: np.ones(b.num_rows)}[norm][row] * threshold * (1 - 1e-9)
            heavy, rest = there & (w >= least), ~there
            take = lambda x, keep: lists(x.filter(pa.array(keep)), row[keep], b.num_rows)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([col("id"), pa.array(size), take(toks, heavy), take(pa.array(w), heavy), take(toks, rest), take(pa.array(n.astype(np.int64)), rest)], ["id", "size", "toks", "ws", "others", "ns"])

    return run


def heavy_tokens(texts: DataFrame, tokenizer: Tokenizer, threshold: float, norm: str | None = "l2", use_idf: bool = True, smooth_idf: bool = True, sublinear_tf: bool = False) -> DataFrame:
    """The rows (id, tok, weight) of tfidf_weights that reach a threshold over 0, for ids of one text each.

    Frequent tokens are weighed where their text lies; only those beyond them are
    shuffled, to be counted and to come back to their text.
    """
    if norm not in ("l1", "l2", None):
        raise ValueError("norm is l1, l2 or None")
    spark = texts.sparkSession
    held = counted(texts, tokenizer.tokens(F.col("text")))
    total, add = held.count(), 1.0 if smooth_idf else 0.0
    known = frequent(held).select("tok", "df").toArrow()
    given = spark.sparkContext.broadcast((known["tok"].combine_chunks(), known["df"].to_numpy().astype(float) if known.num_rows else np.ones(1)))
    kind = held.schema["id"].dataType.simpleString()
    rows = stored(held.mapInArrow(_split(given, total, threshold, norm, use_idf, add, sublinear_tf), f"id {kind}, size double, toks array<string>, ws array<double>, others array<string>, ns array<bigint>"))
    size = lambda x: {"l2": F.sqrt(x), "l1": x, None: F.lit(1.0)}[norm]
    one = lambda w: w * w if norm == "l2" else w
    mass = F.log(F.col("n").cast("double")) + 1 if sublinear_tf else F.col("n").cast("double")
    rest = rows.where(F.size("others") > 0).select("id", "size", F.explode(F.arrays_zip("others", "ns")).alias("t")).select("id", "size", F.col("t.others").alias("tok"), F.col("t.ns").alias("n"))
    # a rare token's texts are as many as its rows, which come together once
    by = rest.groupBy("tok").agg(F.collect_list(F.struct("id", "size", "n")).alias("all")).select("tok", F.size("all").alias("df"), F.explode("all").alias("r")).select("tok", "df", "r.*")
    w = mass * (F.log((F.lit(float(total)) + add) / (F.col("df") + add)) + 1) if use_idf else mass
    by = by.select("id", "tok", w.alias("w"), "size")
    able = F.col("w") >= threshold * (1 - 1e-9) * size(F.col("size") + one(F.col("w")))
    more = by.groupBy("id").agg(F.sum(one(F.col("w"))).alias("more"), F.collect_list(F.when(able, F.struct("tok", "w"))).alias("found"))
    whole = F.col("size") + F.coalesce("more", F.lit(0.0))
    own = F.zip_with("toks", "ws", lambda t, x: F.struct(t.alias("tok"), x.alias("w")))
    every = rows.select("id", "size", own.alias("own")).join(more, "id", "left").select("id", size(whole).alias("all"), F.explode(F.concat("own", F.coalesce("found", F.array().cast("array<struct<tok:string,w:double>>")))).alias("t"))
    return every.select("id", F.col("t.tok").alias("tok"), (F.col("t.w") / F.col("all")).alias("weight")).where(F.col("weight") >= threshold)

"""Numbers of distinct partners by bitmaps, for blocks whose pairs are too many to list."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..functions.text import Tokenizer

LEFT, RIGHT = 4096, 8192
#: A token of more right texts than these has a bitmap, one of fewer a list.
RARE = 32


def profiles(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(id, toks): sorted distinct 64-bit hashes of the tokens; an id of several rows has those of all."""
    own = texts.select("id", F.transform(tokenizer.tokens(F.col("text"), True), lambda t: F.xxhash64(t)).alias("toks")).withColumn("toks", F.coalesce("toks", F.array().cast("array<bigint>")))
    if not texts.groupBy("id").count().where("count > 1").isEmpty():
        own = own.groupBy("id").agg(F.flatten(F.collect_list("toks")).alias("toks"))
    return own.select("id", F.sort_array(F.array_distinct("toks")).alias("toks"))


def _packed(rows: DataFrame, prefix: str, groups: int, value: str) -> DataFrame:
    return rows.groupBy(F.pmod(F.xxhash64("toks"), F.lit(groups)).alias(f"{prefix}_pack")).agg(F.collect_list(F.struct(F.col(value).alias("value"), "toks")).alias(prefix))


def _lists(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a group's rows, their tokens one after the other and how many each has."""
    rows = cell.values
    toks = rows.field("toks")
    return rows.field("value").to_numpy(zero_copy_only=False), toks.flatten().to_numpy(zero_copy_only=False), toks.value_lengths().to_numpy(zero_copy_only=False)


class Held:
    """Which of some lists of tokens hold a token: bitmaps of frequent tokens, places of the others."""

    def __init__(self, toks: np.ndarray, sizes: np.ndarray, weight: np.ndarray):
        self.m, self.weight = len(sizes), weight.astype(float)
        order = np.argsort(toks, kind="stable")
        toks = toks[order]
        self.first = np.flatnonzero(np.r_[True, toks[1:] != toks[:-1]]) if len(toks) else np.zeros(0, int)
        self.known, self.n = toks[self.first], np.diff(np.r_[self.first, len(toks)])
        self.by = np.repeat(np.arange(self.m, dtype=np.int32), sizes)[order]
        common, words = np.flatnonzero(self.n > RARE), -(-self.m // 64)
        self.row = np.full(len(self.known), -1)
        self.row[common] = np.arange(len(common))
        bits = np.zeros((len(common), 8 * words), np.uint8)
        step = max(1, (1 << 24) // max(1, 64 * words))
        for i in range(0, len(common), step):
            part = common[i : i + step]
            mask = np.zeros((len(part), 64 * words), bool)
            mask[np.repeat(np.arange(len(part)), self.n[part]), self.places(part)] = True
            bits[i : i + step] = np.packbits(mask, axis=1, bitorder="little")
        self.bits = bits.view(np.uint64)

    def places(self, tokens: np.ndarray) -> np.ndarray:
        n = self.n[tokens]
        ends = np.cumsum(n)
        return self.by[np.arange(ends[-1] if len(n) else 0) + np.repeat(self.first[tokens] - ends + n, n)]

    def counts(self, toks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each list of tokens the weight of the lists held that share one with it."""
        out = np.zeros(len(sizes), np.int64)
        if not len(self.known):
            return out
        at = np.minimum(np.searchsorted(self.known, toks), len(self.known) - 1)
        hit = self.known[at] == toks
        at, sizes = at[hit], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes))
        row, ends = self.row[at], np.r_[0, np.cumsum(sizes)].tolist()
        for i in np.flatnonzero(sizes).tolist():
            mine, dense = at[ends[i] : ends[i + 1]], row[ends[i] : ends[i + 1]]
            common = dense >= 0
            union = np.bitwise_or.reduce(self.bits[dense[common]], axis=0)
            mask = np.unpackbits(union.view(np.uint8), count=self.m, bitorder="little")
            mask[self.places(mine[~common])] = 1
            out[i] = round(mask.astype(float) @ self.weight)
        return out


def _meet(batches):
    pack, held = None, None
    for whole in batches:
        for batch in (whole.slice(i, 1) for i in range(whole.num_rows)):
            col = lambda n: batch.column(batch.schema.get_field_index(n))[0]  # noqa: B023, E731
            if held is None or col("r_pack").as_py() != pack:
                # one right group meets left ones in turn
                weight, there, there_sizes = _lists(col("r"))
                pack, held = col("r_pack").as_py(), Held(there, there_sizes, weight)
            value, toks, sizes = _lists(col("l"))
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(held.counts(toks, sizes), pa.int64())], ["profile", "n"])


def partner_counts(left: DataFrame, right: DataFrame, tokenizer: Tokenizer, members: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """(id, profile) of left (id, text) if ``members``, and (profile, ids, n): how many right ids share a token with each of the left ones of a profile.

    Entities of equal tokens are one profile; groups of profiles meet and no pair is
    listed. What meets still grows with the product of the sides' profiles.
    """
    conf, key = left.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(key, f"{16 << 20}b")
    own = profiles(left, tokenizer)
    own = settled(own) if members else own
    # numbered in one place: the partition in the upper bits, no shuffle to one task
    mine = settled(own.groupBy("toks").agg(F.count("*").alias("ids")).withColumn("profile", F.monotonically_increasing_id()))
    yours = profiles(right, tokenizer).groupBy("toks").agg(F.count("*").alias("n"))
    groups = [max(1, math.ceil(n / size)) for n, size in ((mine.count(), LEFT), (right.count(), RIGHT))]
    lefts, rights = (_packed(d, p, n, v).repartition(min(n, most), f"{p}_pack") for d, p, n, v, most in ((mine, "l", groups[0], "profile", 12), (yours, "r", groups[1], "n", 6)))
    both = settled(rights).hint("shuffle_replicate_nl").crossJoin(lefts)
    found = both.mapInArrow(_meet, "profile long, n long").groupBy("profile").agg(F.sum("n").alias("n"))
    sums = mine.select("profile", "ids").join(found, "profile", "left").select("profile", "ids", F.coalesce("n", F.lit(0)).alias("n"))
    return own.join(mine, "toks").select("id", "profile") if members else None, sums

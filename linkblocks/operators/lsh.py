"""MinHash with banding, in Column expressions."""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..blocks import BlockSet, ClassBlockSet
from ..functions.lineage import settled
from ..functions.text import Tokenizer
from .base import TextBlocker

PRIME = 2147483647


@lru_cache
def band_shape(threshold: float, num_perm: int, weights: tuple[float, float] = (0.5, 0.5), steps: int = 1000) -> tuple[int, int]:
    """(bands, rows) of the least weighted area of false positives and negatives."""
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights sum to 1")

    def area(f, low: float, high: float) -> float:
        h = (high - low) / steps
        return h * sum(f(low + (i + 0.5) * h) for i in range(steps))

    best = None
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            hit = lambda s, b=b, r=r: 1 - (1 - s**r) ** b
            error = weights[0] * area(hit, 0, threshold) + weights[1] * area(lambda s, hit=hit: 1 - hit(s), threshold, 1)
            if best is None or error < best[0]:
                best = error, (b, r)
    return best[1]


def permutations(n: int, seed: int = 1) -> list[tuple[int, int]]:
    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(n)]


def token_hash(token: Column) -> Column:
    """28 bits of MD5, which any engine can compute."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 7), 16, 10).cast("long")


def signatures(texts: DataFrame, tokenizer: Tokenizer, n: int, seed: int = 1) -> DataFrame:
    """(id, m0, m1, ...): n minima over (a * hash + b) mod a prime; PRIME for each if there are no tokens.

    A row a token and a minimum a permutation: generated code, and partial minima
    before the shuffle, so a text is one row of it. Rows of one id are one text.
    """
    h = F.col("h")
    hashed = texts.select("id", F.explode_outer(tokenizer.tokens(F.col("text"))).alias("tok")).select("id", token_hash(F.col("tok")).alias("h"))
    mins = (F.coalesce(F.min((h * F.lit(a).cast("long") + F.lit(b).cast("long")) % PRIME), F.lit(PRIME).cast("long")).alias(f"m{i}") for i, (a, b) in enumerate(permutations(n, seed)))
    return hashed.groupBy("id").agg(*mins)


def band_rows(texts: DataFrame, tokenizer: Tokenizer, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """(id, band) keys: band number and its minima as one string."""
    key = lambda k: F.concat_ws(",", F.lit(str(k)), *(F.col(f"m{i}").cast("string") for i in range(k * rows, (k + 1) * rows)))
    return signatures(texts, tokenizer, bands * rows, seed).select("id", F.explode(F.array(*(key(k) for k in range(bands)))).alias("band"))


class MinHashLSHBlocker(TextBlocker):
    """A block for each right entity: the left ones that share a band with it.

    Entities of equal signatures are one class; classes meet, by a shuffled join of
    (band, class) rows, whose hot keys adaptive execution splits. Pairs of entities
    are listed only where they are asked for.
    """

    def __init__(self, tokenizer: Tokenizer | None = None, threshold: float = 0.5, num_perm: int = 128, weights: tuple[float, float] = (0.5, 0.5), shape: tuple[int, int] | None = None, seed: int = 1):
        self.tokenizer = tokenizer or Tokenizer()
        self.bands, self.rows = shape or band_shape(threshold, num_perm, tuple(weights))
        self.seed = seed

    def candidate_pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        a = band_rows(left, self.tokenizer, self.bands, self.rows, self.seed).withColumnRenamed("id", "left_id")
        b = band_rows(right, self.tokenizer, self.bands, self.rows, self.seed).withColumnRenamed("id", "right_id")
        return a.join(b, "band").select("left_id", "right_id").distinct()

    def classes(self, texts: DataFrame) -> DataFrame:
        """(id, class): all minima as one string."""
        n = self.bands * self.rows
        return settled(signatures(texts, self.tokenizer, n, self.seed).select("id", F.concat_ws(",", *(F.col(f"m{i}").cast("string") for i in range(n))).alias("class")))

    def _bands(self, classes: DataFrame) -> DataFrame:
        """(class, band), as band_rows has them."""
        m = F.split("class", ",")
        key = lambda k: F.concat_ws(",", F.lit(str(k)), *(m[i] for i in range(k * self.rows, (k + 1) * self.rows)))
        return classes.select("class").distinct().select("class", F.explode(F.array(*(key(k) for k in range(self.bands)))).alias("band"))

    def assign_texts(self, left, right, left_name="left", right_name="right") -> BlockSet:
        a, b = self.classes(left), self.classes(right)
        links = self._bands(a).withColumnRenamed("class", "left_class").join(self._bands(b).withColumnRenamed("class", "right_class"), "band")
        return ClassBlockSet(a, b, settled(links.select("left_class", "right_class").distinct()), left_name, right_name)

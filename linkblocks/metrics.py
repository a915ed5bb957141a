"""Scores of blocks against a gold standard; candidate pairs are never listed for them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BlockSet, CompositeBlockSet, NNBlockSet
from .functions.lineage import settled
from .model import EntityDataset


def harmonic_mean(a, b):
    """Of two numbers or two columns; 0 where both are 0."""
    if isinstance(a, Column) or isinstance(b, Column):
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
        return F.when(a + b == 0, F.lit(0.0)).otherwise(2 * a * b / (a + b))
    return 0.0 if a + b == 0 else 2 * a * b / (a + b)


def _weighted(gold: DataFrame) -> bool:
    return gold.columns[2:] == ["weight"]


def _gold(gold: DataFrame) -> DataFrame:
    """Distinct pairs; a third column ``weight`` tells how many pairs of entities with the same blocks a row stands for."""
    if len(gold.columns) != 2 and not _weighted(gold):
        raise ValueError("gold has two columns, or three with a weight")
    a, b = (F.col(f"`{c}`").cast("string") for c in gold.columns[:2])
    weight = [F.col("weight").cast("bigint").alias("weight")] if _weighted(gold) else []
    return gold.select(a.alias("left_id"), b.alias("right_id"), *weight).distinct()


def _mass(rows: DataFrame, times: Column | None = None) -> Column:
    """Sum of the pairs that rows stand for, times a column."""
    w = F.col("weight") if "weight" in rows.columns else F.lit(1)
    return F.coalesce(F.sum(w if times is None else w * times), F.lit(0)).cast("bigint")


def check_consistent(blocks, gold: DataFrame) -> None:
    if len(gold.columns) != 2 and not _weighted(gold):
        raise ValueError("gold has two columns, or three with a weight")
    if isinstance(blocks, BlockSet) and set(gold.columns[:2]) != set(blocks.columns):
        raise ValueError(f"gold of {gold.columns}, blocks of {blocks.columns}")


def gold_hits(blocks, gold: DataFrame) -> DataFrame:
    """(left_id, right_id, n): gold pairs among the candidates and how often they occur; of weighted gold with its weight.

    Starts from gold, so its cost follows the gold rows and the blocks of their
    entities and not the pairs.
    """
    gold = _gold(gold)
    keys = gold.columns
    if isinstance(blocks, CompositeBlockSet):
        both = gold_hits(blocks.blocks, gold).unionByName(gold_hits(blocks.neighbors, gold))
        return both.groupBy(*keys).agg(F.sum("n").alias("n"))
    if isinstance(blocks, NNBlockSet):
        return blocks.all_pairs().join(gold, ["left_id", "right_id"]).groupBy(*keys).agg(F.count("*").alias("n"))
    left = gold.join(blocks.left.withColumnRenamed("entity_id", "left_id"), "left_id")
    right = blocks.right.withColumnRenamed("entity_id", "right_id")
    return left.join(right, ["right_id", "block_id"]).groupBy(*keys).agg(F.count("*").alias("n"))


def n_pairs(blocks, distinct: bool = False) -> DataFrame:
    """One row (comparisons)."""
    if distinct and isinstance(blocks, BlockSet):
        return blocks.distinct_comparisons()
    if distinct:
        return blocks.all_pairs().distinct().agg(F.count("*").alias("comparisons"))
    if isinstance(blocks, BlockSet):
        return blocks.sizes().agg(F.coalesce(F.sum(F.col("n_left") * F.col("n_right")), F.lit(0)).cast("bigint").alias("comparisons"))
    return blocks.all_pairs().agg(F.count("*").alias("comparisons"))


def metric_columns(left_length: Column, right_length: Column) -> dict[str, Column]:
    """Of columns tp, fn, fp, comparisons."""
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    # lengths are often int literals, whose product is an int too
    reduction = 1 - F.col("comparisons") / (left_length.cast("double") * right_length.cast("double"))
    return {"recall": recall, "precision": precision, "f_measure": harmonic_mean(recall, precision), "reduction_ratio": reduction, "h3r": harmonic_mean(reduction, recall)}


def evaluate(blocks, gold: DataFrame, left_length, right_length, distinct: bool = False, hits: DataFrame | None = None) -> DataFrame:
    """One row of counts and metrics. Without ``distinct``, a pair that is not gold counts as often as it occurs.

    ``hits`` are the gold_hits of these blocks where they are known, from blocks of the gold's entities alone.
    """
    check_consistent(blocks, gold)
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    hits = gold_hits(blocks, gold) if hits is None else hits
    every = _gold(gold)
    # a cross join would broadcast its one row, and a broadcast has to be there within a time
    parts = [n_pairs(blocks, distinct), hits.agg(_mass(hits).alias("tp"), _mass(hits, F.col("n")).alias("hits")), every.agg(_mass(every).alias("gold"))]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(*(F.max(c).alias(c) for c in ("comparisons", "tp", "hits", "gold")))
    taken = F.col("tp") if distinct else F.col("hits")
    rows = rows.select("comparisons", "tp", (F.col("gold") - F.col("tp")).alias("fn"), (F.col("comparisons") - taken).cast("bigint").alias("fp"))
    return rows.select("*", *(c.alias(n) for n, c in metric_columns(as_col(left_length), as_col(right_length)).items()))


METRICS = ("recall", "precision", "f_measure", "reduction_ratio", "h3r")


@dataclass
class Evaluation:
    """Counts of one or several block sets against one gold standard; true positives stay a DataFrame."""

    true_positives: DataFrame
    tp: int
    fn: int
    fp: int
    comparisons: int
    gold_size: int
    left_length: int
    right_length: int
    parts: list = field(default_factory=list, repr=False)

    @classmethod
    def from_blocks(cls, blocks, gold: DataFrame, left_length: int, right_length: int, distinct: bool = False, hits: DataFrame | None = None) -> Evaluation:
        hits = settled(gold_hits(blocks, gold) if hits is None else hits)
        row = evaluate(blocks, gold, left_length, right_length, distinct, hits).first()
        return cls(hits.drop("n"), row.tp, row.fn, row.fp, row.comparisons, row.tp + row.fn, left_length, right_length)

    @classmethod
    def from_dataset(cls, blocks, dataset: EntityDataset, count: str = "entities", distinct: bool = False, hits: DataFrame | None = None) -> Evaluation:
        """count: lengths are numbers of ``entities``, or of ``rows`` of the tables."""
        if count not in ("entities", "rows"):
            raise ValueError("count is 'entities' or 'rows'")
        n = lambda f: (f.entity_ids() if count == "entities" else f.df).count()
        return cls.from_blocks(blocks, dataset.gold, n(dataset.left), n(dataset.right), distinct, hits)

    @classmethod
    def joined(cls, evaluations: list[Evaluation]) -> Evaluation:
        """As if the block sets were one: true positives united, other counts added."""
        first = evaluations[0]
        if any((e.gold_size, e.left_length, e.right_length) != (first.gold_size, first.left_length, first.right_length) for e in evaluations):
            raise ValueError("evaluations of different gold standards")
        hits = first.true_positives
        for e in evaluations[1:]:
            hits = hits.unionByName(e.true_positives)
        hits = hits.distinct()
        tp = hits.agg(_mass(hits)).first()[0]
        return cls(hits, tp, first.gold_size - tp, sum(e.fp for e in evaluations), sum(e.comparisons for e in evaluations), first.gold_size, first.left_length, first.right_length)

    @property
    def recall(self) -> float:
        return self.tp / (self.tp + self.fn) if self.tp + self.fn else 0.0

    pairs_completeness = recall

    @property
    def precision(self) -> float:
        return self.tp / (self.tp + self.fp) if self.tp + self.fp else 0.0

    pairs_quality = precision

    @property
    def f_measure(self) -> float:
        return harmonic_mean(self.recall, self.precision)

    @property
    def reduction_ratio(self) -> float:
        return 1 - self.comparisons / (self.left_length * self.right_length)

    @property
    def h3r(self) -> float:
        return harmonic_mean(self.reduction_ratio, self.recall)

    def to_dict(self) -> dict[str, float]:
        return {"tp": self.tp, "fn": self.fn, "fp": self.fp, "comparisons": self.comparisons} | {m: getattr(self, m) for m in METRICS}


def dice(a: DataFrame, b: DataFrame) -> float:
    """2 |a and b| / (|a| + |b|) of two sets of rows, each as many as its ``weight`` if there is one; 0 if both are empty."""
    count = lambda d: d.agg(_mass(d)).first()[0]
    n = count(a.distinct()) + count(b.distinct())
    return 2 * count(a.intersect(b)) / n if n else 0.0


def compare(a: Evaluation, b: Evaluation, metrics=METRICS) -> dict[str, float]:
    """Dice of the true positives, and the joint evaluation's gain over each, relative to it."""
    metrics = [metrics] if isinstance(metrics, str) else list(metrics)
    both = Evaluation.joined([a, b])
    gain = lambda new, old: (new - old) / old if old else math.nan
    out = {"dice_tp": dice(a.true_positives, b.true_positives)}
    for m in metrics:
        new = getattr(both, m)
        out |= {m: new, f"improvement_{m}_first": gain(new, getattr(a, m)), f"improvement_{m}_second": gain(new, getattr(b, m))}
    return out


def compare_many(evaluations: dict[str, Evaluation], metrics=METRICS) -> list[dict]:
    """A row (base, other, dice_tp, improvement_*) for each ordered pair of names."""
    metrics = [metrics] if isinstance(metrics, str) else list(metrics)
    rows = []
    for x, y in combinations(evaluations, 2):
        c = compare(evaluations[x], evaluations[y], metrics)
        rows.append({"base": x, "other": y, "dice_tp": c["dice_tp"]} | {f"improvement_{m}": c[f"improvement_{m}_first"] for m in metrics})
        rows.append({"base": y, "other": x, "dice_tp": c["dice_tp"]} | {f"improvement_{m}": c[f"improvement_{m}_second"] for m in metrics})
    return rows


def minimal_evaluation(blocks: BlockSet, gold: DataFrame, left_length, right_length, hits: DataFrame | None = None) -> DataFrame:
    """Recall and precision from joins alone, with duplicates."""
    return evaluate(blocks, gold, left_length, right_length, hits=hits).select("tp", "fn", "comparisons", "recall", "precision", "f_measure", "reduction_ratio", "h3r")

"""Entity tables, datasets, vectors."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X


@dataclass(frozen=True)
class EntityFrame:
    """A wide attribute table: one row for each entity, any further columns."""

    df: DataFrame
    id_col: str = "id"
    name: str = "left"

    def __post_init__(self):
        if not self.name:
            raise ValueError("an entity table needs a name")
        if self.id_col not in self.df.columns:
            raise ValueError(f"no column {self.id_col}")

    @property
    def non_id_columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.id_col]

    def with_df(self, df: DataFrame) -> EntityFrame:
        return replace(self, df=df)

    def texts(self) -> DataFrame:
        """(id, text) of all attributes."""
        return X.concat_wide(self.df, self.id_col)

    def entity_ids(self) -> DataFrame:
        return self.df.select(F.col(f"`{self.id_col}`").cast("string").alias("id")).distinct()

    @classmethod
    def from_pandas(cls, spark, pdf, id_col: str, name: str, partitions: int | None = None):
        df = spark.createDataFrame(pdf)
        return cls(df.repartition(partitions) if partitions else df, id_col, name)


@dataclass(frozen=True)
class TripleFrame(EntityFrame):
    """Attribute triples: the id column, a relation, and the value in the third column by position."""

    id_col: str = "head"

    def __post_init__(self):
        super().__post_init__()
        if len(self.df.columns) != 3:
            raise ValueError("triples have three columns")

    @property
    def non_id_columns(self) -> list[str]:
        return [self.df.columns[2]]

    def triples(self) -> DataFrame:
        """(head, relation, tail) as strings."""
        return triples(self.df)

    def texts(self, distinct: bool = True) -> DataFrame:
        return X.concat_triples(self.triples(), distinct=distinct)


def triples(df: DataFrame) -> DataFrame:
    """Three columns by position as (head, relation, tail) strings."""
    h, r, t = (F.col(f"`{c}`").cast("string") for c in df.columns[:3])
    return df.select(h.alias("head"), r.alias("relation"), t.alias("tail"))


@dataclass(frozen=True)
class EntityDataset:
    """Two entity tables, gold matches (two columns) and relation triples if there are any."""

    left: EntityFrame
    right: EntityFrame
    gold: DataFrame
    left_rel: DataFrame | None = None
    right_rel: DataFrame | None = None

    @classmethod
    def build(cls, left, right, gold, left_rel=None, right_rel=None, clean: bool = False, partitions: int | None = None):
        """clean: strip datatype suffixes from triple values."""
        if clean:
            fix = lambda f: f.with_df(f.df.withColumn(f.df.columns[2], X.without_datatype(F.col(f.df.columns[2])))) if isinstance(f, TripleFrame) else f
            left, right = fix(left), fix(right)
        if partitions:
            left, right = (f.with_df(f.df.repartition(partitions)) for f in (left, right))
        if len(gold.columns) != 2 and gold.columns[2:] != ["weight"]:
            raise ValueError("gold has two columns, or three with a weight")
        return cls(left, right, gold.toDF(left.name, right.name, *gold.columns[2:]), left_rel, right_rel)

    def sample(self, fraction: float, seed: int = 42) -> EntityDataset:
        """A random share of the gold rows, the entities in them, and relations that touch these."""
        gold = self.gold.sample(fraction, seed)
        parts = []
        for side, rel, col in ((self.left, self.left_rel, self.gold.columns[0]), (self.right, self.right_rel, self.gold.columns[1])):
            ids = gold.select(F.col(f"`{col}`").cast("string").alias("_id")).distinct()
            df = side.df.join(ids, side.df[side.id_col].cast("string") == ids["_id"], "left_semi")
            if rel is not None:
                t = triples(rel)
                rel = t.join(ids, t["head"] == ids["_id"], "left_semi").unionByName(t.join(ids, t["tail"] == ids["_id"], "left_semi")).dropDuplicates()
            parts.append((side.with_df(df), rel))
        (left, left_rel), (right, right_rel) = parts
        return replace(self, left=left, right=right, gold=gold, left_rel=left_rel, right_rel=right_rel)


def gold_from_clusters(members: DataFrame, left: str, right: str) -> DataFrame:
    """All pairs of one cluster across two sources, of (cluster_id, source, id)."""
    a = members.where(F.col("source") == left).select("cluster_id", F.col("id").alias(left))
    b = members.where(F.col("source") == right).select("cluster_id", F.col("id").alias(right))
    return a.join(b, "cluster_id").select(left, right).distinct()


def synthetic_dataset(spark, n: int = 20, matches: int = 2) -> EntityDataset:
    """Two small graphs of n entities each, of which the first ``matches`` have equal names."""
    def side(p: str):
        names = [(f"{p}{i}", "name", f"match {i}" if i < matches else f"{p} name {i}") for i in range(n)]
        ages = [(f"{p}{i}", "age", str(20 + i % 7)) for i in range(n)]
        rel = [(f"{p}{i}", "near", f"{p}{(i + 1) % n}") for i in range(n)] + [(f"{p}{i}", "rdf:type", f"{p}0") for i in range(0, n, 2)]
        frame = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
        return TripleFrame(frame(names + ages, ("head", "relation", "tail")), "head", p), frame(rel, ("head", "relation", "tail"))

    (left, left_rel), (right, right_rel) = side("a"), side("b")
    gold = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(matches)], "a string, b string")
    return EntityDataset.build(left, right, gold, left_rel, right_rel)


class VectorTable:
    """(name, vec): unique names with vectors of one length."""

    def __init__(self, df: DataFrame, check: bool = False):
        self.df = df.select(F.col("name").cast("string").alias("name"), F.col("vec").cast("array<double>").alias("vec"))
        if check:
            n, names, sizes = self.df.agg(F.count("*"), F.count_distinct("name"), F.count_distinct(F.size("vec"))).first()
            if names != n:
                raise ValueError("names repeat")
            if sizes > 1:
                raise ValueError("vectors differ in length")

    @classmethod
    def from_rows(cls, spark, names, vectors) -> VectorTable:
        names, vectors = list(names), [[float(x) for x in v] for v in vectors]
        if len(names) != len(vectors):
            raise ValueError("names and vectors differ in number")
        return cls(spark.createDataFrame(list(zip(names, vectors, strict=True)), "name string, vec array<double>"), check=True)

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, name) -> list:
        """The vector of a name, or those of a list of names in their order."""
        if isinstance(name, str):
            row = self.df.where(F.col("name") == name).first()
            if row is None:
                raise KeyError(name)
            return row.vec
        found = {r.name: r.vec for r in self.df.where(F.col("name").isin(*name)).collect()}
        return [found[n] for n in name]

    def replace(self, name: str, vector) -> VectorTable:
        new = F.array(*(F.lit(float(x)) for x in vector))
        return VectorTable(self.df.withColumn("vec", F.when(F.col("name") == name, new).otherwise(F.col("vec"))))

    def subset(self, names: DataFrame) -> VectorTable:
        """The rows whose names are in the first column."""
        return VectorTable(self.df.join(names.select(F.col(names.columns[0]).cast("string").alias("name")).distinct(), "name", "left_semi"))

    def without(self, names: DataFrame) -> VectorTable:
        return VectorTable(self.df.join(names.select(F.col(names.columns[0]).cast("string").alias("name")).distinct(), "name", "left_anti"))

    def concat(self, other: VectorTable) -> VectorTable:
        return VectorTable(self.df.unionByName(other.df), check=True)

    def equals(self, other: VectorTable) -> bool:
        a, b = self.df, other.df
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

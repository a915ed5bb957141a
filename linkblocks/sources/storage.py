"""Parquet forms of blocks and vectors, and datasets from Parquet paths."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..blocks import BlockSet, CompositeBlockSet, NNBlockSet
from ..model import EntityDataset, EntityFrame, TripleFrame

BLOCKS, NEIGHBORS = "blocks", "nn_blocks"


def write_blocks(blocks, path: str, mode: str = "overwrite") -> None:
    """Blocks as (block_id, list, list), neighbours as one column a rank, both kinds in two folders."""
    path = path.rstrip("/")
    if isinstance(blocks, CompositeBlockSet):
        write_blocks(blocks.blocks, f"{path}/{BLOCKS}", mode)
        write_blocks(blocks.neighbors, f"{path}/{NEIGHBORS}", mode)
    else:
        blocks.wide().write.mode(mode).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def read_blocks(spark: SparkSession, path: str, left_name: str = "left", right_name: str = "right"):
    """The kind follows from the folders and the schema; no row is read for it."""
    path = path.rstrip("/")
    neighbors = _read(spark, f"{path}/{NEIGHBORS}")
    if neighbors is not None:
        return CompositeBlockSet(BlockSet.from_wide(spark.read.parquet(f"{path}/{BLOCKS}")), NNBlockSet.from_wide(neighbors, left_name, right_name))
    df = spark.read.parquet(path)
    if len(df.columns) == 3 and isinstance(df.schema[1].dataType, T.ArrayType):
        return BlockSet.from_wide(df)
    return NNBlockSet.from_wide(df, left_name, right_name)


def save_vectors(left: DataFrame, right: DataFrame, path: str, mode: str = "overwrite") -> None:
    left.write.mode(mode).parquet(f"{path.rstrip('/')}/left")
    right.write.mode(mode).parquet(f"{path.rstrip('/')}/right")


def load_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    found = [_read(spark, f"{path.rstrip('/')}/{side}") for side in ("left", "right")]
    if None in found:
        raise FileNotFoundError(f"no vectors in {path}")
    return found[0], found[1]


def read_dataset(spark: SparkSession, left: str, right: str, gold: str, left_rel: str | None = None, right_rel: str | None = None, triples: bool = True, id_col: str = "head", clean: bool = False, names=("left", "right")) -> EntityDataset:
    kind = TripleFrame if triples else EntityFrame
    side = lambda p, n: kind(spark.read.parquet(p), id_col, n)
    rel = lambda p: spark.read.parquet(p) if p else None
    return EntityDataset.build(side(left, names[0]), side(right, names[1]), spark.read.parquet(gold), rel(left_rel), rel(right_rel), clean)

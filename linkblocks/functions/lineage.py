"""Cutting of plans that grow with every round of a loop."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint where the session has a folder for it, else a cache that a lost executor's part is computed into again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    return df.persist()


def bounded(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A settled table with a broadcast hint if it has at most so many rows, and without one beyond that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def stored(df: DataFrame) -> DataFrame:
    """A table in Parquet beside the checkpoints, which takes less room than one of them; settled where the session has no folder for it."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        return settled(df)
    path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

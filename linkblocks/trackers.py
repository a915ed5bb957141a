"""Where runs report parameters and metrics."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def flattened(d: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested dictionaries as one, names joined by dots."""
    out: dict[str, Any] = {}
    for k, v in d.items():
        out |= flattened(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


class Tracker:
    """Reports nothing."""

    def parameters(self, values: dict[str, Any]) -> None:
        pass

    def metrics(self, values: dict[str, Any]) -> None:
        pass


class ConsoleTracker(Tracker):
    def parameters(self, values):
        print(json.dumps({"parameters": flattened(values)}, default=str))

    def metrics(self, values):
        print(json.dumps({"metrics": flattened(values)}, default=str))


class TableTracker(Tracker):
    """Appends rows (run, kind, name, value) to a Parquet table."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run

    def _write(self, kind: str, values: dict[str, Any]) -> None:
        rows = [(self.run, kind, k, str(v)) for k, v in flattened(values).items()]
        if rows:
            self.spark.createDataFrame(rows, "run string, kind string, name string, value string").coalesce(1).write.mode("append").parquet(self.path)

    def parameters(self, values):
        self._write("parameter", values)

    def metrics(self, values):
        self._write("metric", values)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def run_id(parameters: dict[str, Any]) -> str:
    """The same for the same parameters."""
    return hashlib.sha1(json.dumps(flattened(parameters), sort_keys=True, default=str).encode()).hexdigest()

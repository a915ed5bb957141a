"""Command line: run a blocker over Parquet tables and score it, or score stored blocks.

python -m linkblocks.cli run --left L --right R --gold G [--left-rel ..] --blocker token --options '{"min_token_length": 4}' --out DIR
python -m linkblocks.cli evaluate --left L --right R --gold G --blocks DIR
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from .metrics import Evaluation
from .registry import BLOCKERS, blocker
from .sources.storage import read_blocks, read_dataset, write_blocks
from .trackers import ConsoleTracker, TableTracker, Tracker, run_id


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkblocks", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "evaluate"):
        s = sub.add_parser(name)
        for x in ("left", "right", "gold"):
            s.add_argument(f"--{x}", required=True)
        s.add_argument("--left-rel")
        s.add_argument("--right-rel")
        s.add_argument("--wide", action="store_true", help="tables have a column for each attribute")
        s.add_argument("--id-col", default="head")
        s.add_argument("--names", nargs=2, default=["left", "right"])
        s.add_argument("--clean", action="store_true", help="strip datatype suffixes of values")
        s.add_argument("--sample", type=float, help="share of gold matches")
        s.add_argument("--seed", type=int, default=42)
        s.add_argument("--count", choices=("entities", "rows"), default="entities")
        s.add_argument("--distinct", action="store_true", help="count every pair once")
        s.add_argument("--track", default="console", help="console, none, or a folder for a table")
    sub.choices["run"].add_argument("--blocker", required=True, choices=sorted(BLOCKERS))
    sub.choices["run"].add_argument("--options", type=json.loads, default={})
    sub.choices["run"].add_argument("--out", required=True)
    sub.choices["evaluate"].add_argument("--blocks", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, float]:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("linkblocks").getOrCreate()
    given = {k: v for k, v in vars(a).items() if k != "track"}
    tracker = ConsoleTracker() if a.track == "console" else Tracker() if a.track == "none" else TableTracker(spark, a.track, run_id(given))
    tracker.parameters(given)
    data = read_dataset(spark, a.left, a.right, a.gold, a.left_rel, a.right_rel, not a.wide, a.id_col, a.clean, tuple(a.names))
    if a.sample:
        data = data.sample(a.sample, a.seed)
    path, times = (a.out, {}) if a.command == "run" else (a.blocks, {})
    if a.command == "run":
        began = time.time()
        write_blocks(blocker(a.blocker, **a.options).assign(data.left, data.right, data.left_rel, data.right_rel), path)
        times["time_in_s"] = time.time() - began
    found = Evaluation.from_dataset(read_blocks(spark, path, *a.names), data, a.count, a.distinct).to_dict() | times
    tracker.metrics(found)
    return found


if __name__ == "__main__":
    main()

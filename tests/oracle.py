"""Runs a registered query and its SQL side by side: python tests/oracle.py SF NAME..."""

import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    out = []
    for r in pdf.itertuples(index=False):
        out.append(tuple(None if x is None or x != x else round(x, 6) if isinstance(x, float) else x for x in (v.item() if hasattr(v, "item") else v for v in r)))
    return sorted(out, key=repr)


def compare(spark, name, query, sql, sf_dir):
    t = time.time()
    got = query(spark, sf_dir).toPandas()
    took = time.time() - t
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    con = duckdb.connect()
    for x in TABLES:
        con.execute(f"create view {x} as select * from read_parquet('{sf_dir}/{x}.parquet')")
    want = con.sql(sql).df()
    a, b = rows_of(got), rows_of(want)
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: COLUMNS {sorted(got.columns)} {sorted(want.columns)}"
    bad = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    return f"{name}: {'ok' if a == b else f'DIFFERS {bad[:2]}'} {len(a)} {len(b)} rows, {took:.1f} s"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    q, s = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] if sys.argv[2:] != ["all"] else q:
        try:
            print(compare(spark, n, q[n], s.get(n), f"/root/testdata/sf{sys.argv[1]}"), flush=True)
        except Exception as x:
            print(f"{n}: ERROR {str(x)[:600]}", flush=True)

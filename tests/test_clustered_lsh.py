"""The values of clustered_attribute_lsh get their labels from their vectors."""

from pathlib import Path

import duckdb

from linkblocks import plans
from linkblocks.operators.clustering import as_triples
from linkblocks.plans import composed
from linkblocks.plans import inputs as I
from linkblocks.vectors import encoders as E
from linkblocks.vectors import knn as K

from .oracle import TABLES, compare

NAME, SMALL = "clustered_attribute_lsh", Path("/root/testdata/sf0.001")


def test_words_decide_and_not_lengths(spark, tmp_path):
    for t in TABLES:
        if t not in ("customer", "supplier"):
            (tmp_path / f"{t}.parquet").symlink_to(SMALL / f"{t}.parquet")
    # all are of nine letters; a text and its turned one have one vector
    spark.createDataFrame([(1, "pear plum", None, 1), (2, "lime kiwi", None, 2), (3, None, None, 3)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "plum pear", 1), (2, "kiwi lime", 2), (3, None, 3)], "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for t in ("customer", "supplier"):
        (tmp_path / f"{t}.parquet").rename(tmp_path / f"{t}.d")
        (tmp_path / f"{t}.parquet").symlink_to(next((tmp_path / f"{t}.d").glob("*.parquet")))
    rows = {r.block_id: (r.n_left, r.n_right) for r in plans.queries()[NAME](spark, str(tmp_path)).collect()}
    assert rows["s1"] == rows["s2"] == (1, 1) and "s3" not in rows
    assert ": ok " in compare(spark, NAME, plans.queries()[NAME], plans.oracle_sql()[NAME], str(tmp_path))


def test_labels_of_values_equal_sql(spark):
    sides = (as_triples(I.graph_attributes(spark, str(SMALL), k)).where("tail is not null").selectExpr("tail as id", "tail as text").distinct() for k in (0, 1))
    found = K.clustered(*E.AverageEncoder(size=8).encode(*sides), min_cluster_size=2)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    want = con.sql(f"with recursive {I.GRAPH}, {composed._ONE}, {composed._density_sql('a where tail is not null', 8)} select side, tail, label from dl").fetchall()
    assert {(k, r.id, r.label) for k, d in enumerate(found) for r in d.collect()} == set(want)
    assert len({label for *_, label in want}) > 20

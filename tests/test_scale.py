"""What fails on large tables, in small."""

from pathlib import Path

import pytest
from linkblocks import plans
from linkblocks.metrics import Evaluation, compare, evaluate, gold_hits
from linkblocks.operators.token import TokenBlocker
from linkblocks.plans import inputs as I

from .oracle import TABLES
from .oracle import compare as against_sql

MANY = 128_205
TEXTS = [(0, "red apple"), (1, "red apple"), (2, "red apple"), (3, "red apple"), (4, "green pear"), (5, "green pear"), (6, "of"), (7, "of"), (8, None), (9, None), (10, "plum"), (11, "red")]


def documents(spark, tmp_path, rows=TEXTS) -> str:
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def token_blocks(spark, sf):
    return TokenBlocker().assign(I.documents(spark, sf, 0), I.documents(spark, sf, 1))


def both(spark, sf):
    """Pairs and classes of equal texts, and the hits of the classes' own documents."""
    pairs, (classes, left, right) = I.exact_copies(spark, sf), I.copies(spark, sf)
    return pairs, classes, gold_hits(TokenBlocker().assign(left, right), classes)


def test_lengths_whose_product_is_no_int(spark, tmp_path):
    sf = documents(spark, tmp_path)
    pairs, classes, hits = both(spark, sf)
    a = Evaluation.from_blocks(token_blocks(spark, sf), pairs, MANY, MANY)
    b = Evaluation.from_blocks(token_blocks(spark, sf), classes, MANY, MANY, hits=hits)
    assert a.to_dict() == b.to_dict() and (a.tp, a.fn) == (5, 1)
    assert a.reduction_ratio == pytest.approx(1 - a.comparisons / MANY**2)
    for e in (a, b):
        c = compare(e, e, "recall")
        assert (c["dice_tp"], c["recall"]) == (1, a.recall)


def test_ids_of_several_texts_are_no_classes(spark, tmp_path):
    sf = documents(spark, tmp_path, [*TEXTS, (0, "plum"), (13, "plum"), (0, "red apple")])
    pairs, classes, hits = both(spark, sf)
    a, b = (evaluate(token_blocks(spark, sf), g, 9, 9, hits=h).first() for g, h in ((pairs, None), (classes, hits)))
    assert a == b


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory) -> str:
    """100,000 short documents: the product of the sides' lengths is no int."""
    path = tmp_path_factory.mktemp("many")
    small = Path("/root/testdata/sf0.001")
    for t in TABLES:
        if t != "documents":
            (path / f"{t}.parquet").symlink_to(small / f"{t}.parquet")
    spark.range(100_000).selectExpr("id as doc_id", "concat('w', repeat('x', cast(id div 2 % 9 as int)), id div 2 % 20000) as text").coalesce(1).write.parquet(f"{path}/d")
    (path / "documents.parquet").symlink_to(next((path / "d").glob("*.parquet")))
    return str(path)


@pytest.mark.parametrize("name", ["blocks_compared"])
def test_evaluations_of_long_sides(spark, many, name):
    assert ": ok " in against_sql(spark, name, plans.queries()[name], plans.oracle_sql()[name], many)

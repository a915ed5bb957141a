import pytest
from pyspark.sql import functions as F

from linkblocks.blocks import BlockSet
from linkblocks.operators.lsh import MinHashLSHBlocker

N = 3000


def texts(spark, side: str, words: list[str]):
    """N entities of each text, a few alone, one without a token."""
    return spark.range(N).select(F.concat(F.lit(side), F.col("id").cast("string")).alias("id"), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % len(words) + 1).cast("int")).alias("text"))


def counted(blocks: BlockSet):
    """Sizes from the memberships themselves."""
    rows = BlockSet(blocks.left, blocks.right, *blocks.columns).sizes().collect()
    return sorted((r.block_id, r.n_left, r.n_right) for r in rows)


def plain(rows):
    return sorted((r.block_id, r.n_left, r.n_right) for r in rows.collect())


def test_equal_signatures_meet_once(spark):
    blocks = MinHashLSHBlocker(shape=(4, 2)).assign_texts(texts(spark, "a", ["red apple", "of"]), texts(spark, "b", ["red apple", "green pear", "the"]))
    assert blocks.links.count() == 2  # 3.5 million pairs of entities
    sizes = plain(blocks.sizes())
    assert len(sizes) == N // 3 * 2 and {r[1:] for r in sizes} == {(N // 2, 1)}


@pytest.mark.parametrize("words", [["red apple", "green pear"], ["plum", "of"]])
def test_sizes_of_two_views(spark, words):
    lsh = MinHashLSHBlocker(shape=(4, 2))
    small = lambda side, w: texts(spark, side, w).limit(60)
    a = lsh.assign_texts(small("a", ["red apple", "red pear", "of"]), small("b", ["red apple", "big red pear"]))
    b = lsh.assign_texts(small("a", words).where("id not like '%3'"), small("b", [*words, "red apple"]).where("id not like '%4'"))
    both = a.combine(b)
    assert plain(both.sizes()) == counted(both) and plain(a.sizes()) == counted(a)

from collections import Counter

from linkblocks.blocks import BlockSet, NNBlockSet, combine_blocks


def test_pairs_of_one_block_are_not_grouped(spark):
    blocks = BlockSet.from_dict(spark, {1: (["a", "b", "c"], ["x", "y"]), 2: (["c", "d"], ["y", "z"]), 3: (["e"], [])})
    near = NNBlockSet(spark.createDataFrame([("a", 0, "x"), ("a", 1, "x"), ("a", 2, "q"), ("c", 0, "y"), ("c", 1, "q"), ("f", 0, "x"), ("d", 0, None), ("e", 0, "x")], "left_id string, rank int, right_id string"))
    both = combine_blocks(near, blocks)
    got = both.pair_counts().collect()
    want = Counter((r.left_id, r.right_id) for r in both.all_pairs().collect())
    assert {(r.left_id, r.right_id): r.n for r in got} == want and len(got) == len(want)

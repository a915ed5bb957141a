import pytest

from linkblocks.blocks import BlockSet, CompositeBlockSet, NNBlockSet, combine_blocks
from linkblocks.metrics import Evaluation, compare, compare_many, dice, evaluate, harmonic_mean
from linkblocks.sources.storage import load_vectors, read_blocks, write_blocks

BLOCKS = {1: ([8, 9], [7]), 3: ([8], [7, 6]), 9: ([5], [5]), 12: ([2, 9, 5], [6]), 15: ([2], [3]), 21: ([9], [7])}
SIZES = {str(k): len(a) + len(b) for k, (a, b) in BLOCKS.items()}
PAIRS = sorted((x, y) for a, b in BLOCKS.values() for x in a for y in b)


def made(spark, blocks=BLOCKS, columns=("A", "B")):
    return BlockSet.from_dict(spark, blocks, columns)


def test_sizes_and_pairs(spark):
    b = made(spark)
    assert {r.block_id: r.assignments for r in b.block_sizes().collect()} == SIZES
    assert b.mean_block_size() == pytest.approx(sum(SIZES.values()) / len(SIZES)) and len(b) == len(SIZES)
    assert sorted((int(r.left_id), int(r.right_id)) for r in b.all_pairs().collect()) == PAIRS
    s, total = b.statistics(4, 4).first(), sum(SIZES.values())
    assert (s.pairs, s.assignments, s.comparisons_cardinality, s.overall_cardinality) == (len(PAIRS), total, total / len(PAIRS), total / 8)
    assert sorted(r.block_id for r in b.find_blocks(8, "A").collect()) == ["1", "3"]
    assert sorted((int(r.entity), int(r.other)) for r in b.entity_pairs(7, "B").collect()) == sorted((y, x) for x, y in PAIRS if y == 7)
    assert b[3].first()["B"] == ["6", "7"]
    with pytest.raises(ValueError):
        b.find_blocks(1, "C")


def test_combine(spark):
    other = made(spark, {12: BLOCKS[12], 9: ([1, 2], [5]), 20: ([5], [7])})
    got = made(spark).combine(other).to_dict()
    assert got["9"] == (["1", "2", "5"], ["5"]) and got["20"] == (["5"], ["7"]) and got["12"] == (["2", "5", "9"], ["6"]) and len(got) == len(BLOCKS) + 1
    assert other.combine(made(spark)).to_dict() == got
    with pytest.raises(ValueError):
        made(spark).combine(made(spark, columns=("A", "C")))


def test_purge(spark):
    b = made(spark, {i: (list(range(i % 3 + 1)), list(range(i % 2 + 1))) for i in range(12)})
    kept = b.purge(1)
    assert set(kept.to_dict()) <= set(b.to_dict())
    assert b.iterative_threshold().first().threshold >= 1


def test_parquet_round_trips(spark, tmp_path):
    b = made(spark)
    n = NNBlockSet(spark.createDataFrame([("x", 0, "p"), ("x", 1, "q"), ("y", 0, "q")], "left_id string, rank int, right_id string"), "A", "B")
    for k, x in enumerate((b, n, CompositeBlockSet(b, n))):
        write_blocks(x, str(tmp_path / str(k)))
        got = read_blocks(spark, str(tmp_path / str(k)), "A", "B")
        assert type(got) is type(x) and got.columns == ["A", "B"]
        assert sorted(got.all_pairs().collect()) == sorted(x.all_pairs().collect())
    with pytest.raises(FileNotFoundError):
        load_vectors(spark, str(tmp_path / "none"))


def test_neighbours(spark):
    n = NNBlockSet(spark.createDataFrame([("x", 0, "p"), ("x", 1, "q"), ("y", 0, "q"), ("y", 1, None)], "left_id string, rank int, right_id string"))
    assert n.all_pairs().count() == 3 and n.n_neighbors() == 2
    s = n.statistics(2, 4)
    assert (s["assignments"], s["comparisons"], s["comparisons_cardinality"], s["overall_cardinality"]) == (3, 2, 1.5, 4 / 6)
    assert {r.block_id: r.assignments for r in n.block_sizes().collect()} == {"x": 3, "y": 2}
    both = combine_blocks(n, n)
    assert both.n_neighbors() == 4 and both.all_pairs().count() == 6
    assert isinstance(combine_blocks(n, made(spark)), CompositeBlockSet) and isinstance(combine_blocks(made(spark), n), CompositeBlockSet)


def gold(spark):
    return spark.createDataFrame([(f"A:{i}", f"B:{i}") for i in range(1, 7)], "A string, B string")


FIRST = {0: (["A:1", "A:4"], ["B:1", "B:2"]), 1: (["A:5"], ["B:5", "B:3"]), 2: (["A:6", "A:2"], ["B:4"])}


def counted(blocks, n_gold=6):
    """tp, fn, fp by listing all pairs."""
    pairs = [(x[2:], y[2:]) for a, b in blocks.values() for x in a for y in b]
    tp = len({p for p in pairs if p[0] == p[1] and int(p[0]) <= n_gold})
    return tp, n_gold - tp, sum(x != y for x, y in pairs), len(pairs)


def test_evaluation(spark):
    e = Evaluation.from_blocks(made(spark, FIRST), gold(spark), 9, 6)
    tp, fn, fp, n = counted(FIRST)
    assert (e.tp, e.fn, e.fp, e.comparisons) == (tp, fn, fp, n) == (2, 4, 6, 8)
    r, p, rr = tp / 6, tp / (tp + fp), 1 - n / 54
    assert e.recall == pytest.approx(r) and e.precision == pytest.approx(p) and e.f_measure == pytest.approx(2 * r * p / (r + p))
    assert e.reduction_ratio == pytest.approx(rr) and e.h3r == pytest.approx(2 * rr * r / (rr + r))
    row = evaluate(made(spark, FIRST), gold(spark), 9, 6).first()
    assert row.h3r == pytest.approx(e.h3r)
    none = {0: (["A:1", "A:2"], ["B:6"]), 1: (["A:4"], ["B:5", "B:3"])}
    e = Evaluation.from_blocks(made(spark, none), gold(spark), 9, 6)
    assert (e.tp, e.fn, e.fp) == counted(none)[:3] and (e.recall, e.precision, e.f_measure) == (0, 0, 0)
    with pytest.raises(ValueError):
        Evaluation.from_blocks(made(spark, FIRST, ("A", "C")), gold(spark), 9, 6)
    empty = Evaluation.from_blocks(made(spark, {}), gold(spark), 9, 6)
    assert (empty.tp, empty.fp, empty.precision) == (0, 0, 0.0)


def test_duplicates_and_comparison(spark):
    more = FIRST | {9: (["A:1"], ["B:1", "B:3"])}
    twice = made(spark, more)
    a, b = Evaluation.from_blocks(twice, gold(spark), 9, 6), Evaluation.from_blocks(twice, gold(spark), 9, 6, distinct=True)
    assert (a.tp, a.fp, a.comparisons) == (2, 7, 10) and (b.tp, b.fp, b.comparisons) == (2, 7, 9)
    other = Evaluation.from_blocks(made(spark, {0: (["A:3"], ["B:3"])}), gold(spark), 9, 6)
    both = Evaluation.joined([a, other])
    assert (both.tp, both.fp, both.comparisons) == (3, 7, 11)
    c = compare(a, other, "recall")
    assert c["dice_tp"] == 0 and c["improvement_recall_first"] == pytest.approx(0.5)
    assert len(compare_many({"x": a, "y": b, "z": other}, "recall")) == 6
    assert dice(a.true_positives, b.true_positives) == 1
    with pytest.raises(ValueError):
        Evaluation.joined([a, Evaluation.from_blocks(twice, gold(spark), 8, 6)])
    assert harmonic_mean(0, 0) == 0

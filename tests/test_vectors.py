import numpy as np
import pytest

from linkblocks.functions import counts
from linkblocks.operators.clustering import handle_noise
from linkblocks.vectors import encoders as E
from linkblocks.vectors import knn as K
from linkblocks.vectors.hdbscan import hdbscan

LEFT = {"a0": (-10.02214045, 10.4762855), "a1": (4.40456117, -4.30098781), "a2": (-10.20858901, 9.92864014), "a3": (-8.41744546, 9.30333293), "a4": (-3.19137254, -6.58221354), "a5": (-4.36686114, -4.4813946)}
RIGHT = {"b0": (6.07713967, -2.9225191), "b1": (-4.94871681, -3.99066116), "b2": (-9.6390726, 11.09024066), "b3": (4.37318904, -4.4791316)}


def frames(spark):
    return tuple(spark.createDataFrame([(k, list(v)) for k, v in d.items()], "name string, vec array<double>") for d in (LEFT, RIGHT))


def test_hdbscan_blocks(spark):
    b = K.HdbscanBuilder(2).build(*frames(spark))
    got = {frozenset([*x, *y]) for x, y in b.to_dict().values()}
    assert got == {frozenset(["a0", "a2", "a3", "b2"]), frozenset(["a4", "a5", "b1"]), frozenset(["a1", "b0", "b3"])}


def test_hdbscan_finds_separate_clusters():
    r = np.random.RandomState(17)
    x = np.concatenate([r.randn(30, 3) * 0.3 + c for c in ([0, 0, 0], [9, 9, 0], [0, 9, 9])])
    for method in ("eom", "leaf"):
        labels = hdbscan(x, 5, method=method)
        assert all(len(set(labels[i : i + 30]) - {-1}) == 1 for i in (0, 30, 60)) or method == "leaf"
    assert (hdbscan(x[:1]) == -1).all()


@pytest.mark.parametrize("metric", K.METRICS)
def test_nearest_is_exact(spark, metric):
    left, right = frames(spark)
    a, b = np.array(list(LEFT.values())), np.array(list(RIGHT.values()))
    d = K.distances(a, b, metric)
    for pack in (2, 100):
        got = {(r.left_id, r.rank): r.right_id for r in K.nearest(left, right, 3, metric, pack).collect()}
        assert got == {(x, k): list(RIGHT)[j] for x, row in zip(LEFT, d, strict=True) for k, j in enumerate(np.argsort(row)[:3])}


@pytest.mark.parametrize("method", [h for h in K.HUBNESS if h])
def test_hubness(spark, method):
    b = K.NearestNeighborBuilder(2, 3, hubness=method).build(*frames(spark))
    assert b.all_pairs().count() == 12


def test_sinkhorn_columns_sum_to_one(spark):
    c = K.nearest(*frames(spark), 4).select("left_id", "right_id", "distance")
    w = K.sinkhorn(c, 5).toPandas()
    assert np.allclose(w.groupby("right_id").weight.sum(), 1)


def test_first_component_goes(spark):
    df = spark.createDataFrame([(str(i), [float(i), 2.0 * i, (i * 7) % 5 - 2.0]) for i in range(1, 30)], "id string, vec array<double>")
    x = np.array([r.vec for r in df.collect()])
    v = np.linalg.svd(x)[2][0]
    got = np.array([r.vec for r in E.without_first_component(df).collect()])
    assert np.allclose(got, x - np.outer(x @ v, v))


def test_noise(spark):
    df = spark.createDataFrame([("x", -1), ("y", 0), ("z", 1)], "value string, label int")
    got = lambda **k: {r.value: r.label for r in handle_noise(df, **k).collect()}
    assert got(how="keep") == {"x": "-1", "y": "0", "z": "1"} and got(how="remove") == {"y": "0", "z": "1"}
    assert got(how="remove", compat=True) == {"z": "1"} and got(how="token") == {"x": "x", "y": "0", "z": "1"}
    with pytest.raises(ValueError):
        handle_noise(df, "other")


def test_checks(spark):
    df = spark.createDataFrame([("1", "a", "b")], "id string, x string, y string")
    with pytest.raises(ValueError):
        E.AverageEncoder().encode(df, df)
    two = df.select("id", "x")
    got = E.FunctionEncoder(lambda texts: [[len(t), 1.0] for t in texts]).encode(two, two)[0].first()
    assert got.vec == [1.0, 1.0]


def test_approximate_neighbours(spark):
    r = np.random.RandomState(3)
    x = r.randn(120, 8)
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "name string, vec array<double>")
    a, b = df.where("cast(substr(name, 2) as int) % 2 = 0"), df.where("cast(substr(name, 2) as int) % 2 = 1")
    exact = {(q.left_id, q.right_id) for q in K.nearest(a, b, 3).collect()}
    got = {(q.left_id, q.right_id) for q in K.builder("approximate", n_neighbors=3, tables=24, bits=4).build(a, b).df.collect()}
    assert len(exact & got) >= 0.9 * len(exact)


def test_clusters_of_several_groups(spark, monkeypatch):
    """Vectors that no one place may hold together: the trees of pairs of groups give the labels of all at once."""
    r = np.random.RandomState(3)
    x = np.concatenate([r.randn(40, 3) * s + c for s, c in ((0.3, [0, 0, 0]), (0.8, [9, 9, 0]), (0.1, [0, 9, 9]), (4, [4, 4, 4]))] + [np.ones((9, 3))])
    x = np.round(x[r.permutation(len(x))], 6)
    rows = [(f"{i:03d}", [float(v) for v in p]) for i, p in enumerate(x)]
    frame = lambda part: spark.createDataFrame(part, "name string, vec array<double>").repartition(3)
    for options in ({"min_cluster_size": 5}, {"min_cluster_size": 4, "min_samples": 7, "metric": "cosine", "method": "leaf"}):
        want = hdbscan(x, **options)
        with monkeypatch.context() as m:
            m.setattr(K, "GROUP", 16)
            m.setattr(K, "JOINED", 2)
            found = K.clustered(frame(rows[:90]), frame(rows[90:]), **options)
        got = {r.id: r.label for side in found for r in side.collect()}
        assert [got[n] for n, _ in rows] == want.tolist()


def test_clustering_has_no_most_rows(spark):
    n = 20_500
    frame = spark.range(n).selectExpr("cast(id as string) as name", "array(cast(id % 41 as double), cast(id % 500 as double) / 1e4) as vec")
    a, b = K.clustered(frame.where("name % 2 = 0"), frame.where("name % 2 = 1"), min_cluster_size=100)
    assert a.union(b).groupBy("label").count().where("label >= 0").count() == 41


@pytest.mark.parametrize("known", [0, 3, 1000])
def test_means_of_hashed_tokens_are_not_exploded(spark, monkeypatch, known):
    """Sums in place and of rare tokens equal those by a table of all words; texts without a token have a vector of their id."""
    monkeypatch.setattr(counts, "FREQUENT", known)
    words = "red green blue plum pear kiwi lime fig".split()
    texts = spark.createDataFrame([(i % 2, f"d{i}", None if i == 7 else " ".join(words[(i * k) % 8] for k in range(i % 6))) for i in range(60)], "side int, id string, text string").repartition(3)
    table = E.hash_vectors(spark.createDataFrame([(w,) for w in words], "tok string"), 5)
    for kind in (E.AverageEncoder, E.SifEncoder):
        want = {(r.side, r.id): r.vec for r in kind(table, size=5).vectors(texts).collect()}
        monkeypatch.setattr(kind, "tokens", None)
        got = kind(size=5).vectors(texts).collect()
        monkeypatch.undo()
        monkeypatch.setattr(counts, "FREQUENT", known)
        assert len(got) == 60 and all(r.vec == pytest.approx(want[r.side, r.id]) for r in got)

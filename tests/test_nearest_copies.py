import numpy as np
import pytest

from linkblocks.vectors import knn as K


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_equal_vectors_meet_once(spark, metric, monkeypatch):
    r = np.random.RandomState(1)
    kinds = r.randint(1, 9, (6, 3)).astype(float)
    rows = lambda p, n: [(f"{p}{i}", [float(x) for x in kinds[i % (6 if p == "a" else 4)]]) for i in range(n)]
    a, b = rows("a", 300), rows("b", 200)
    frame = lambda x: spark.createDataFrame(x, "name string, vec array<double>").repartition(3)
    sizes, packed = {}, K._packed

    def counted(df, prefix, size):
        sizes[prefix] = df.count()
        return packed(df, prefix, size)

    monkeypatch.setattr(K, "_packed", counted)
    got = {}
    for x in K.nearest(frame(a), frame(b), 5, metric).collect():
        got.setdefault(x.left_id, []).append((x.rank, x.right_id, x.distance))
    assert sizes == {"l": 6, "r": 4}
    d = np.round(K.distances(np.array([v for _, v in a]), np.array([v for _, v in b]), metric), 9)
    for i, (name, _) in enumerate(a):
        want = sorted((d[i, j], b[j][0]) for j in range(len(b)))[:5]
        assert [(n, pytest.approx(x)) for _, n, x in sorted(got[name])] == [(n, x) for x, n in want]


def test_a_group_of_many_right_vectors(spark):
    r = np.random.RandomState(2)
    b = r.randn(5000, 2)
    whole = K.closest(b[:50], b, 3, "euclidean")
    K_matrix, K.MATRIX = K.MATRIX, 20_000
    try:
        parts = K.closest(b[:50], b, 3, "euclidean")
    finally:
        K.MATRIX = K_matrix
    assert all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in zip(whole, parts, strict=True))


def test_groups_of_the_left_side_are_tasks(spark):
    frame = spark.range(400).selectExpr("cast(id as string) as name", "array(cast(id as double), cast(id % 7 as double)) as vec")
    assert K._packed(frame, "l", 20).rdd.getNumPartitions() == 20
    got = {r.left_id: r.right_id for r in K.nearest(frame, frame, 1, pack=20).collect()}
    assert len(got) == 400 and all(a == b for a, b in got.items())

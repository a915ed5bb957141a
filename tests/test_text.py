import pytest
from pyspark.sql import functions as F

from linkblocks.functions import text as X
from linkblocks.model import EntityDataset, EntityFrame, TripleFrame, VectorTable, gold_from_clusters, synthetic_dataset

from .fixtures import relations, triples, wide


def test_concat(spark):
    df = spark.createDataFrame([("v", None, "1"), (" x ", 5, "2")], "wc1 string, wc2 int, id string")
    assert {r.id: r.text for r in X.concat_wide(df, "id").collect()} == {"1": "v", "2": "x  5"}
    left, right = triples(spark)
    assert {r.id: set(r.text.split()) for r in right.texts().collect()}["b1"] == {"Harbor", "Lights", "1999-03-21"}
    assert {r.id: r.text for r in wide(spark)[0].texts().collect()}["a4"] == "Marble Fox 2015-01-30 Ghana fable"


def test_tokens_and_grams(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(X.Tokenizer().tokens, "The 11-12-1973 don't a_b clustering_label_5 ÉTÉ 12") == ["11-12-1973", "a_b", "clustering_label_5", "été"]
    assert one(X.Tokenizer(stop_words=()).tokens, "the cat") == ["cat"]
    assert one(X.qgrams, "abcd") == ["abc", "bcd"] and one(X.qgrams, "ab") == [] and one(X.qgrams, None) is None
    assert one(X.without_datatype, "5^^xsd:int") == "5"
    assert one(lambda c: X.row_tokens([c, c]), "A a A") == ["A", "a"]


def test_frames(spark):
    with pytest.raises(ValueError):
        EntityFrame(wide(spark)[0].df, "nope")
    with pytest.raises(ValueError):
        TripleFrame(wide(spark)[0].df, "id")
    left, right = triples(spark)
    gold = spark.createDataFrame([("a1", "b1"), ("a2", "b2"), ("a3", "b3")], "x string, y string")
    d = EntityDataset.build(left, right, gold, *relations(spark), clean=True)
    s = d.sample(0.7, seed=3)
    ids = {r.A for r in s.gold.collect()}
    assert {r.head for r in s.left.df.collect()} == ids
    assert all(r.head in ids or r.tail in ids for r in s.left_rel.collect())


def test_gold_from_clusters(spark):
    rows = [(1, "A", "a1"), (1, "B", "b1"), (1, "B", "b2"), (2, "A", "a2")]
    assert sorted(map(tuple, gold_from_clusters(spark.createDataFrame(rows, "cluster_id int, source string, id string"), "A", "B").collect())) == [("a1", "b1"), ("a1", "b2")]


def test_vector_table(spark):
    v = VectorTable.from_rows(spark, "abcd", [[i, i + 1] for i in range(4)])
    assert len(v) == 4 and v["b"] == [1, 2] and v[["d", "a"]] == [[3, 4], [0, 1]]
    assert v.replace("a", [9, 9])["a"] == [9, 9]
    assert v.subset(spark.createDataFrame([("a",), ("c",)], "n string")).equals(VectorTable.from_rows(spark, "ac", [[0, 1], [2, 3]]))
    with pytest.raises(ValueError):
        v.concat(v)
    with pytest.raises(ValueError):
        VectorTable.from_rows(spark, "aa", [[1], [2]])
    with pytest.raises(KeyError):
        v["z"]


def test_synthetic_dataset_is_solved_by_names(spark):
    from linkblocks.operators import UniqueNameBlocker
    from linkblocks.operators.graph import count_entities, name_pairs

    d = synthetic_dataset(spark)
    assert {tuple(r) for r in UniqueNameBlocker().assign(d.left, d.right).all_pairs().collect()} == {("a0", "b0"), ("a1", "b1")}
    n = [count_entities(f.df, r) for f, r in ((d.left, d.left_rel), (d.right, d.right_rel))]
    assert {(r.left_id, r.right_id) for r in name_pairs(d.left.triples(), d.right.triples(), *n, 1).collect()} == {("a0", "b0"), ("a1", "b1")}

import pytest
from pyspark.sql import functions as F

from linkblocks.functions import counts
from linkblocks.functions.text import Tokenizer
from linkblocks.operators import token as T

TEXTS = ["red apple red", "green pear apple", "", None, "red red red", "plum", "of the", "apple pear plum kiwi lime red green"]


def frame(spark, p, k):
    return spark.createDataFrame([(f"{p}{i}", None if TEXTS[i % 8] is None else f"{TEXTS[i % 8]} {TEXTS[i * k % 7] or ''}") for i in range(40)], "id string, text string").repartition(3)


@pytest.mark.parametrize("options", [{}, {"norm": "l1", "sublinear_tf": True}, {"norm": None, "smooth_idf": False}, {"use_idf": False}])
def test_heavy_tokens_are_those_of_all_weights(spark, monkeypatch, options):
    texts, threshold = frame(spark, "a", 3), 1.5 if options.get("norm", 1) is None else 0.3
    want = {(r.id, r.tok): r.weight for r in T.tfidf_weights(texts, Tokenizer(), **options).where(F.col("weight") >= threshold).collect()}
    for known in (0, 2, 1000):
        monkeypatch.setattr(counts, "FREQUENT", known)
        got = T.heavy_tokens(texts, Tokenizer(), threshold, **options).collect()
        assert {(r.id, r.tok): pytest.approx(r.weight) for r in got} == want and len(got) == len(want)


def test_tokens_are_not_shuffled_one_by_one(spark, monkeypatch):
    """All tokens are frequent here: none is dealt out, and those of a block are paired in parts."""
    monkeypatch.setattr(T, "PART", 3)
    left, right = frame(spark, "a", 3), frame(spark, "b", 5)
    assigned = T.TfIdfTokenBlocker(0.3)
    monkeypatch.setattr(T, "tfidf_weights", None)
    pairs = [tuple(r) for r in assigned.assign_texts(left, right).pairs().select("block_id", "left_id", "right_id").collect()]
    monkeypatch.undo()
    tag = lambda d, s: d.select(F.struct(F.lit(s).alias("s"), F.col("id").alias("i")).alias("id"), "text")
    kept = T.tfidf_weights(tag(left, 0).unionByName(tag(right, 1)), Tokenizer()).where("weight >= 0.3").collect()
    want = [(a.tok, a.id.i, b.id.i) for a in kept for b in kept if a.id.s == 0 and b.id.s == 1 and a.tok == b.tok]
    assert sorted(pairs) == sorted(want) and len(want) > 100

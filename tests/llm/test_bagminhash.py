import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkblocks.llm import bagminhash as B
from linkblocks.llm import words as W


def bag(text, n=5):
    w = [x for x in __import__("re").split("[ \t\n\r\x0b\x0c]+", "".join(c.lower() if c.isascii() else c for c in text)) if x]
    return Counter([" ".join(w)] if 0 < len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)])


def jaccard(a, b):
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def brute(rows):
    """Class of each id by comparing all pairs."""
    label = {i: i for i, _ in rows}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if jaccard(bag(a or ""), bag(b or "")) >= 0.8:
            x, y = label[i], label[j]
            for k in label:
                if label[k] in (x, y):
                    label[k] = min(x, y)
    return label


def made(seed=1, n=60):
    r = random.Random(seed)
    voc = ["w%d" % i for i in range(300)] + ["É", "ß", "日本"]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            w = (r.choice(rows)[1] or "x").split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                if w:
                    w[r.randrange(len(w))] = r.choice(voc)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(r.choice(voc) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 60, 200])))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b " * 3000), (n + 4, "a b " * 3000 + "c")]


def test_bags_and_overlap_are_exact():
    rows = made()
    data, at = W.utf8(pa.array([t for _, t in rows]))
    row, s, w = B.bags(data, at)
    for i, (_, t) in enumerate(rows):
        assert sorted(w[row == i].tolist()) == sorted(bag(t or "").values())
    names, texts = {}, [t for _, t in rows]
    x = B.bags(*W.utf8(pa.array(texts[:-1])))
    y = B.bags(*W.utf8(pa.array(texts[1:])))
    want = [jaccard(bag(a or ""), bag(b or "")) for a, b in itertools.pairwise(texts)]
    assert np.allclose(B.overlap(x, y, len(texts) - 1), want)


def test_registers_agree_as_often_as_the_similarity():
    shingle = np.arange(40, dtype=np.uint64)
    wa, wb = np.arange(40) % 7 + 1, np.arange(40) * 3 % 11 + 1
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    a, b = (B.signatures(np.zeros(40, np.int64), W.mix(shingle), w, 1, 6000) for w in (wa, wb))
    assert abs((a == b).mean() - want) < 0.03


def test_classes_equal_brute_force(spark):
    rows = made()
    got = {r.doc_id: r.class_id for r in B.near_duplicates(spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, bands int")).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert B.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_find_what_leaders_miss(spark, monkeypatch):
    """Chains of small edits: neighbours are near, ends aren't, and blocks of two members must still meet."""
    monkeypatch.setattr(B, "BLOCK", 2)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(40):
        base = list(base)
        base[(i * 7) % 120] = f"x{i}"
        rows.append((i, " ".join(base)))
    got = {r.doc_id: r.class_id for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_rows_without_an_id(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "lonely text of no id here"), (5, None)]
    got = [(r.doc_id, r.class_id) for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 4), (4, 4), (None, None), (5, 5)], key=str)


def test_a_dense_group_has_few_pairs(spark):
    """Members of a group of 1,500 near copies meet a few leaders, and make one class with a chain of theirs."""
    r = random.Random(6)
    base = [f"d{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        w = list(base)
        for _ in range(2):
            w[r.randrange(200)] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = B.signed(df).selectExpr("doc_id as rep", "posexplode(bands) as (band, key)")
    shared = marks.join(marks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    assert B._led(shared, None, 0).count() < 12 * len(rows)
    assert {r.class_id for r in B.near_duplicates(df).collect()} == {0}

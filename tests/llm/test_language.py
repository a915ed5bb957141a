import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkblocks.llm import language as L
from linkblocks.llm import words as W


def test_tables_equal_the_network():
    net = L.Net(3)
    x = np.random.RandomState(0).randint(0, 256, (300, L.WINDOW)).astype(np.uint8)
    assert np.allclose(L.Tables(net).logits(x), net.forward(x)[0], atol=1e-4)


def test_gradient():
    net = L.Net(3)
    x = np.random.RandomState(0).randint(97, 105, (5, 20)).astype(np.uint8)
    y = np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(L.softmax(net.forward(x)[0].astype(float))[np.arange(5), y]).sum()
    logits, kept = net.forward(x)
    d = L.softmax(logits)
    d[np.arange(5), y] -= 1
    for p, g in zip(net.parameters(), net.step_back(d, kept), strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[i]
        p[i] = old + 1e-3
        up = loss()
        p[i] = old - 1e-3
        down = loss()
        p[i] = old
        assert abs((up - down) / 2e-3 - g[i]) < 2e-2 * max(1, abs(g[i]))


def test_windows():
    x, n = L.windows(*W.utf8(pa.array(["", "Ab", "x" * 129, None])))
    assert n.tolist() == [0, 1, 2, 0] and x[0, :3].tolist() == [97, 98, 0] and x[2, :2].tolist() == [120, 0]


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, net = L.learn(docs)
    rows = L.predict(docs, langs, net).join(docs, "doc_id").where(L.fold_is(F.col("doc_id"), 4, 2)).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id)
    assert (rows.lang == rows.lang_pred).mean() > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "é"), (5, "the " * 20000), (5, "the " * 20000)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.predict(odd, langs, net).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in langs and 0 <= got[5].score <= 1
    assert L.learn(docs.where("false")) == ([], None)
    assert {r.lang_pred for r in L.predict(odd, [], None).collect()} == {"und"}

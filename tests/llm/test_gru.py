import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from linkblocks.llm import gru as G


def toks(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_gradients():
    net = G.Gru(20, state=4, size=6)
    for p in net.parameters()[:6]:
        p *= 5
    r = np.random.RandomState(0)
    x, y = r.randint(0, 20, (2, 7, 3))
    fresh, real = r.rand(7, 3) < 0.2, r.rand(7, 3) < 0.9
    h = r.randn(3, 4).astype(np.float32)

    def loss():
        out, _, _ = net.states(h, x, fresh)
        return -net.log_probability(out.reshape(-1, 4), y.reshape(-1))[real.reshape(-1)].sum(dtype=float) / real.sum()

    got, grads, _ = net.gradients(h, x, y, fresh, real)
    assert abs(got - loss()) < 1e-4
    for p, g in zip(net.parameters(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[i]
        p[i] = old + 1e-2
        up = loss()
        p[i] = old - 1e-2
        down = loss()
        p[i] = old
        assert abs((up - down) / 2e-2 - g[i]) < 2e-3 + 0.03 * abs(g[i])


def test_probabilities_sum_to_one():
    net = G.Gru(21, state=4, size=6)
    h = np.random.RandomState(0).randn(1, 4).astype(np.float32)
    assert abs(np.exp(net.log_probability(np.repeat(h, 21, 0), np.arange(21))).sum() - 1) < 1e-5


def test_lanes_and_windows_do_not_matter():
    net = G.Gru(30)
    r = np.random.RandomState(1)
    texts = [r.randint(1, 30, n).astype(np.int16) for n in (0, 5, 200, 3, 77, 1, 0, 40)]
    one = [G.score_texts(net, [t], 1, 1000)[0] for t in texts]
    assert np.allclose(G.score_texts(net, texts, 3, 7), one, atol=1e-3)


def test_base_score_is_exact_and_model_learns(spark, monkeypatch):
    monkeypatch.setattr(G, "SYMBOLS", 60)
    got = {r.doc_id: r for r in G.op8_gru_score(spark, "/root/testdata/sf0.001").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    c = Counter(w for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in toks(t))
    n, v = sum(c.values()), len(c)
    for i, t in docs.items():
        w = toks(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert abs(got[i].base_score - want) < 1e-6 * abs(want) + 1e-6
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_are_joined(spark):
    rows = [(i, "a b c " * (i + 1) + f"only{i} Twice twice") for i in range(12)] + [(50, None), (51, ""), (51, ""), (52, "never x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where("doc_id < 12")
    got = G.score(df, *G.learn(train, known=2)).collect()
    assert len(got) == len(rows)
    c = Counter(w for i, t in rows if i < 12 for w in toks(t))
    n, v = sum(c.values()), len(c)
    for r in got:
        w = toks(dict(rows)[r.doc_id])
        assert r.n_known == sum(c[x] > 0 for x in w)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in G.score(df, *G.learn(df.where("false"))).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and math.isfinite(got[1].score)


def test_all_texts_train_the_model(spark, monkeypatch):
    """One long text must not keep the others from the training, nor must more texts than a part holds."""
    rows = [(0, "x " * 310_000)] + [(i, "a b c d e f " * 40) for i in range(1, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (1_000_000, 50_000):
        monkeypatch.setattr(G, "PART", part, raising=False)
        got = [r for r in G.score(df, *G.learn(df)).collect() if r.doc_id]
        # each word tells the next one, which the counts don't know
        assert len(got) == 499 and sum(r.score for r in got) > 0.3 * sum(r.base_score for r in got)


def plain(net, symbols):
    """The log-likelihood of one text, token by token, in float64."""
    k = net.u.shape[0]
    x, u, b, cw, cb, ww, wb = (p.astype(np.float64) for p in net.parameters())
    h, last, total = np.zeros(k), G.END, 0.0
    for y in [*symbols, G.END]:
        i, g = x[last] + b, h @ u
        z, r = 1 / (1 + np.exp(-(i[:k] + g[:k]))), 1 / (1 + np.exp(-(i[k : 2 * k] + g[k : 2 * k])))
        n = np.tanh(i[2 * k :] + r * g[2 * k :])
        h = (1 - z) * n + z * h
        c, w = divmod(int(y), net.size)
        a, s = h @ cw + cb, h @ ww[c] + wb[c]
        total += a[c] - np.log(np.exp(a).sum()) + s[w] - np.log(np.exp(s).sum())
        last = int(y)
    return total


def test_score_is_that_of_a_plain_loop(spark):
    """Symbols, states and the split of a kind's probability, recomputed from words alone at the shipped settings."""
    r = np.random.RandomState(2)
    words = [f"w{i}{'abcd'[i % 4]}" for i in range(1500)]
    text = lambda: " ".join(words[i] for i in [*(r.pareto(0.7, 40) * 8).clip(0, 1499).astype(int), *r.randint(0, 1500, 60)])
    rows = [(i, text()) for i in range(60)] + [(60, None), (61, "unseen words .")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table_of, scale, net = G.learn(df.where("doc_id < 50"), known=1100)
    got = {r.doc_id: r.score for r in G.score(df, table_of, scale, net).collect()}
    c = Counter(w for i, t in rows if i < 50 for w in toks(t)[:-1])
    key = {w: int(G.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for _, t in rows for w in toks(t)[:-1]}
    named = sorted(c, key=lambda w: (-c[w], key[w]))[: G.SYMBOLS]
    symbol = {w: 1 + G.KINDS + i for i, w in enumerate(named)}
    kind = {w: key[w] % G.KINDS for w in key}
    rest = Counter()
    for w in c:
        if w not in symbol:
            rest[kind[w]] += c[w] + 1
    for i, t in rows:
        some = toks(t)[:-1]
        loose = [w for w in some if w not in symbol]
        want = plain(net, [symbol.get(w, 1 + kind[w]) for w in some]) / math.log(10) + sum(math.log10((c[w] + 1) / (rest[kind[w]] + 1)) for w in loose)
        assert abs(got[i] - want) < 1e-3 * abs(want) + 1e-3
    assert len(c) > G.SYMBOLS


def test_a_text_of_a_million_tokens_is_scored_whole():
    net = G.Gru(40, state=8)
    long = np.tile(np.arange(1, 40, dtype=np.int16), 26_000)[:1_000_000]
    texts = [long, *(long[i : i + 50] for i in range(600))]
    tracemalloc.start()
    got = G.score_texts(net, texts)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert np.isfinite(got).all() and abs(got[3] - plain(net, texts[3])) < 1e-2
    assert abs(got[0] / 1_000_001 - plain(net, long[:4000]) / 4001) < 1e-2


def test_model_is_better_than_counts_where_it_never_read(spark):
    """Held-out texts at the shipped settings."""
    got = [r for r in G.op8_gru_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_documents_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert G.score(df, *G.learn(df)).count() == 0
    more = spark.createDataFrame([(1, "a b", "x", 3, 4), (1, "a b", "y", 3, 4)], "doc_id long, text string, word string, n long, row long")
    assert G.score(more, *G.learn(more)).count() == 2

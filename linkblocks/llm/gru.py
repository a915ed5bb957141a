"""Scores of whole texts under a gated recurrent language model.

Tokens are words (ASCII capitals lowered) and one end for each text. Word counts
come from all training texts. The model predicts symbols: the end, each of the
``SYMBOLS`` most frequent words, and for all other words the ``KINDS`` kinds that
their last two bytes make; the words of a kind then have its probability split by
count plus one, with one share for words never seen. So every word of the corpus
has its own probability. The output softmax over symbols is factored: a class first,
then a symbol of that class. Training is truncated back-propagation in numpy over
all training texts: a hash deals them to groups, as many as the corpus needs, and to
``ROUNDS``; the first group's first share, some ``PART`` tokens, starts the network,
then in each round all groups train on from one network and their parameters are
averaged by tokens, partition by partition. Texts are scored whole: they are laid
end to end into lanes that advance together, a window at a time, and each lane's
state is carried from window to window until its text ends; memory grows with the
tokens of a pool of texts, or of one text where that is longer.

Counts of the ``KNOWN`` most frequent words are broadcast, a bound that doesn't
grow; the other words of a text are joined with the counts by key.

Edge cases: a null or empty text is one end token; with no training text all
counts are 0; repeated rows each get a row; extra columns are ignored; a null id
is not held out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import mapped, table, text_or_empty, written
from .language import fold_is

FOLDS, HELD_OUT = 7, 2
SYMBOLS, CLASS_SIZE, STATE = 959, 32, 16
#: Kinds of the words without a symbol, a power of two; the last bits of a word's hash.
KINDS = 64
KNOWN = 1 << 18
#: Tokens of a group in a round, about, and rounds
PART, ROUNDS = 1_000_000, 2
LANES, STEPS, POOL = 512, 64, 3_000_000
#: Symbols: the end, the kinds, then words.
END = 0


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, with their kinds as last bits, and the first word of each row."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, at)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    tail = data[ends - 1].astype(np.uint64) << np.uint64(8) | data[np.maximum(ends - 2, starts)].astype(np.uint64)
    mask = np.uint64(KINDS - 1)
    return W.hashes(data, starts, ends) & ~mask | W.mix(tail) & mask, first


def _counted(batches):
    """Word counts of a partition, summed over some millions of words at a time."""
    held: list[np.ndarray] = []

    def out():
        k, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        data, at = W.utf8(batch.column(0))
        for i, j in W.chunks(at):
            held.append(tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])[0])
            if sum(map(len, held)) > 4_000_000:
                yield out()
    if held:
        yield out()


def counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word hash occurs in docs (text)."""
    return mapped(docs.select(text_or_empty().alias("text")), _counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Gru:
    def __init__(self, symbols: int, state: int = STATE, size: int = CLASS_SIZE, seed: int = 1):
        r = np.random.RandomState(seed)
        classes = -(-symbols // size)
        init = lambda *s: (r.randn(*s) * 0.1).astype(np.float32)
        self.size, self.symbols = size, symbols
        self.x = init(symbols, 3 * state)  # embedding times input weights, in one
        self.u = init(state, 3 * state)
        self.b = np.zeros(3 * state, np.float32)
        self.cw, self.cb = init(state, classes), np.zeros(classes, np.float32)
        self.ww, self.wb = init(classes, state, size), np.zeros((classes, size), np.float32)
        # places of the last class that no symbol has
        self.wb[-1, symbols - (classes - 1) * size :] = -1e9

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.cw, self.cb, self.ww, self.wb]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, flat: np.ndarray) -> None:
        for p, part in zip(self.parameters(), np.split(flat, np.cumsum([p.size for p in self.parameters()])[:-1]), strict=True):
            p[...] = part.reshape(p.shape)

    def step(self, h: np.ndarray, x: np.ndarray):
        k = h.shape[1]
        g = h @ self.u
        zr = x[:, : 2 * k] + g[:, : 2 * k]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        n = zr[:, k:] * g[:, 2 * k :]
        n += x[:, 2 * k :]
        np.tanh(n, out=n)
        out = h - n
        out *= zr[:, :k]
        out += n
        return out, zr, n, g[:, 2 * k :]

    def states(self, h: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, keep: bool = False):
        """Runs a window (steps, lanes); fresh marks the first token of a text. Returns all states, the last one, and what a step back needs."""
        xs = self.x[inputs] + self.b
        live = 1 - fresh.astype(np.float32)[:, :, None]
        out = np.empty((*inputs.shape, h.shape[1]), np.float32)
        kept = []
        for t in range(len(inputs)):
            h0 = h * live[t] if fresh[t].any() else h
            h, zr, n, g = self.step(h0, xs[t])
            out[t] = h
            if keep:
                kept.append((h0, zr, n, g))
        return out, h, (kept, live)

    def log_probability(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithm of the symbols y after the states h."""
        c, w = np.divmod(y, self.size)
        a = h @ self.cw
        a += self.cb
        a -= a.max(1, keepdims=True)
        out = a[np.arange(len(y)), c]
        out -= np.log(np.exp(a, out=a).sum(1))
        order = np.argsort(c.astype(np.uint16), kind="stable")
        ends = np.searchsorted(c[order], np.arange(len(self.ww) + 1))
        for k in range(len(self.ww)):
            rows = order[ends[k] : ends[k + 1]]
            if len(rows):
                s = h[rows] @ self.ww[k] + self.wb[k]
                s -= s.max(1, keepdims=True)
                out[rows] += s[np.arange(len(rows)), w[rows]] - np.log(np.exp(s).sum(1))
        return out

    def gradients(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, real: np.ndarray):
        """Of the mean loss over real tokens of a window; the state before it is taken as given."""
        out, last, (kept, live) = self.states(h, inputs, fresh, keep=True)
        steps, lanes, k = out.shape
        flat, y, m = out.reshape(-1, k), targets.reshape(-1), real.reshape(-1)
        n = max(1, m.sum())
        c, w = np.divmod(y, self.size)
        a = flat @ self.cw + self.cb
        a -= a.max(1, keepdims=True)
        p = np.exp(a, out=a)
        p /= p.sum(1, keepdims=True)
        m32 = (m / n).astype(np.float32)
        rows = np.arange(len(y))
        loss = -np.log(p[rows, c])[m].sum()
        p[rows, c] -= 1
        p *= m32[:, None]
        g = [np.zeros_like(x) for x in self.parameters()]
        g[3], g[4] = flat.T @ p, p.sum(0)
        d_out = p @ self.cw.T
        order = np.argsort(c.astype(np.uint16), kind="stable")
        ends = np.searchsorted(c[order], np.arange(len(self.ww) + 1))
        for j in range(len(self.ww)):
            some = order[ends[j] : ends[j + 1]]
            if not len(some):
                continue
            at, of = np.arange(len(some)), flat[some]
            s = of @ self.ww[j] + self.wb[j]
            q = np.exp(s - s.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            loss -= np.log(q[at, w[some]])[m[some]].sum()
            q[at, w[some]] -= 1
            q *= m32[some][:, None]
            g[5][j], g[6][j] = of.T @ q, q.sum(0)
            d_out[some] += q @ self.ww[j].T
        d_out = d_out.reshape(out.shape)
        dh = np.zeros((lanes, k), np.float32)
        dx = np.empty((steps, lanes, 3 * k), np.float32)
        for t in range(steps - 1, -1, -1):
            h0, zr, nn, gn = kept[t]
            z, r = zr[:, :k], zr[:, k:]
            d = dh + d_out[t]
            da = d * (1 - z) * (1 - nn * nn)
            np.multiply(d * (h0 - nn), z * (1 - z), out=dx[t, :, :k])
            np.multiply(da * gn, r * (1 - r), out=dx[t, :, k : 2 * k])
            dx[t, :, 2 * k :] = da
            dg = dx[t].copy()
            dg[:, 2 * k :] *= r
            g[1] += h0.T @ dg
            dh = (d * z + dg @ self.u.T) * live[t]
        g[2] = dx.sum((0, 1))
        order = np.argsort(inputs.reshape(-1).astype(np.uint16), kind="stable")
        which, begin = np.unique(inputs.reshape(-1)[order], return_index=True)
        g[0][which] = np.add.reduceat(dx.reshape(-1, 3 * k)[order], begin)
        return loss / n, g, last


def lanes(sizes: np.ndarray, most: int = LANES) -> list[list[int]]:
    """Texts dealt to lanes, longest first, each to the shortest lane; lanes with most tokens come first."""
    heap = [(0, i) for i in range(max(1, min(most, len(sizes))))]
    out: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable"):
        n, k = heap[0]
        out[k].append(int(i))
        heapq.heapreplace(heap, (n + int(sizes[i]), k))
    return sorted(out, key=lambda x: -sum(int(sizes[i]) for i in x))


def train(net: Gru, symbols: list[np.ndarray], epochs: int = 1, steps: int = 32, most: int = 256, rate: float = 1e-2) -> int:
    """Trains the network on texts laid end to end and cut into lanes; the number of tokens."""
    y = np.concatenate([np.r_[x, END] for x in symbols]).astype(np.int16) if symbols else np.zeros(0, np.int16)
    size = len(y)
    if not size:
        return 0
    many = int(np.clip(size // 2048, 1, most))
    fresh = np.r_[True, y[:-1] == END]
    x = np.where(fresh, END, np.r_[END, y[:-1]])
    width = -(-size // many)
    cut = lambda a: np.pad(a, (0, many * width - size)).reshape(many, width).T
    real, x, y, fresh = cut(np.ones(size, bool)), cut(x), cut(y), cut(fresh)
    m, v, t = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2)), None, 0
    m, v = m
    for _ in range(epochs):
        h = np.zeros((x.shape[1], net.u.shape[0]), np.float32)
        for i in range(0, len(x), steps):
            k = slice(i, i + steps)
            _, grads, h = net.gradients(h, x[k], y[k], fresh[k], real[k])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            t += 1
            now = rate * max(0.05, 1 - t * steps / (epochs * len(x)))
            for p, g, a, b in zip(net.parameters(), grads, m, v, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-6))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return size


def score_texts(net: Gru, symbols: list[np.ndarray], most: int = LANES, steps: int = STEPS) -> np.ndarray:
    """Natural log-likelihood of the symbols of each text and its end."""
    sizes = np.array([len(s) + 1 for s in symbols])
    dealt = lanes(sizes, most)
    order = np.array([i for x in dealt for i in x])
    stop = np.cumsum(sizes[order])
    begin = stop - sizes[order]
    # lane after lane, text after text
    y = np.zeros(stop[-1], np.int16)
    for i, k in zip(order, begin, strict=True):
        y[k : k + sizes[i] - 1] = symbols[i]
    x = np.r_[END, y[:-1]]
    fresh = np.zeros(len(y), bool)
    fresh[begin] = True
    x[begin] = END
    total = np.array([sizes[x].sum() for x in dealt])  # lanes are in order of their tokens
    lane = np.cumsum(total) - total
    logs = np.zeros(len(y))
    h = np.zeros((len(dealt), net.u.shape[0]), np.float32)
    for i in range(0, total[0], steps):
        live = int((total > i).sum())
        t = i + np.arange(min(steps, total[0] - i))[:, None]
        inside = t < total[:live]
        at = np.where(inside, lane[:live] + t, 0)
        out, h, _ = net.states(h[:live], x[at], fresh[at] & inside)
        p = net.log_probability(out.reshape(-1, out.shape[2]), y[at].reshape(-1))
        logs[at[inside]] = p[inside.reshape(-1)]
    found = np.empty(len(symbols))
    found[order] = np.add.reduceat(logs, begin)
    return found


class Scale:
    """What is known of the corpus: the most frequent words with their counts, and totals, those of kinds as (words, distinct words)."""

    def __init__(self, top: list[tuple[int, int]], kinds: np.ndarray, n_texts: int):
        top = sorted(((np.uint64(w & (1 << 64) - 1), c) for w, c in top), key=lambda t: (-t[1], t[0]))
        keys = np.array([w for w, _ in top], np.uint64)
        n = np.array([c for _, c in top], np.int64)
        order = np.argsort(keys)
        self.keys, self.c = keys[order], n[order]
        kind = (keys & np.uint64(KINDS - 1)).astype(np.int64)
        named = min(SYMBOLS, len(keys))
        symbol = 1 + kind
        symbol[:named] = 1 + KINDS + np.arange(named)
        self.symbol = symbol[order].astype(np.int16)
        self.n_symbols = 1 + KINDS + named
        self.n = int(kinds[:, 0].sum()) + n_texts  # with the ends
        self.v = int(kinds[:, 1].sum()) + (n_texts > 0)
        self.n_texts = n_texts
        # counts plus one of the words of a kind that have no symbol, and one for the unseen
        rest = kinds.sum(1) + 1.0
        rest -= np.bincount(kind[:named], n[:named] + 1, KINDS)
        self.log_rest = np.log10(rest)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and count; count 0 for words that aren't among the most frequent."""
        other = (1 + (h & np.uint64(KINDS - 1)).astype(np.int64)).astype(np.int16)
        if not len(self.keys):
            return other, np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        ok = self.keys[i] == h
        return np.where(ok, self.symbol[i], other), np.where(ok, self.c[i], 0)


SCORED = "row long, doc_id long, n_words long, known long, base double, other double, model double, rare array<long>, rare_n array<int>"


def _scorer(scale, net):
    def run(batches):
        s, g = scale.value, net.value
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        serial = 0
        pool: list[tuple] = []
        size = 0

        def out():
            nonlocal serial, size
            symbols = [p[1] for p in pool]
            model = score_texts(g, symbols)
            ids = pa.array([p[0] for p in pool], pa.int64())
            cols = [np.array([p[k] for p in pool]) for k in range(2, 6)]
            rare = [p[6] for p in pool]
            ends = pa.array(np.r_[0, np.cumsum([len(k) for k, _ in rare])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in rare]).astype(t))) for k, t in ((0, np.int64), (1, np.int32))]
            row = pa.array(part + serial + np.arange(len(pool)))
            serial += len(pool)
            pool.clear()
            size = 0
            n, known, base, other = cols
            return pa.RecordBatch.from_arrays(
                [row, ids, pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(other), pa.array(model), *lists],
                ["row", "doc_id", "n_words", "known", "base", "other", "model", "rare", "rare_n"],
            )

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, at = W.utf8(batch.column(1))
            for i, j in W.chunks(at):
                h, first = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
                symbol, c = s.look_up(h)
                log = np.log10(c + 1.0)
                sums = np.r_[0, np.cumsum(log)]
                loose = (symbol > END) & (symbol <= KINDS)
                others = np.r_[0, np.cumsum(np.where(loose, log - s.log_rest[np.where(loose, symbol - 1, 0)], 0))]
                many = np.r_[0, np.cumsum(c > 0)]
                for k in range(j - i):
                    a, b = first[k], first[k + 1]
                    rare = np.unique(h[a:b][c[a:b] == 0].view(np.int64), return_counts=True)
                    pool.append((ids[i + k], symbol[a:b], b - a, many[b] - many[a], sums[b] - sums[a], others[b] - others[a], rare))
                    size += b - a + 1
                    if size >= POOL:
                        yield out()
        if pool:
            yield out()

    return run


def _apart(key: np.ndarray) -> np.ndarray:
    """Keys with the later ones of equal keys changed, so that a row repeated very often isn't one group's alone."""
    order = np.argsort(key, kind="stable")
    some = key[order]
    head = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
    serial = np.arange(len(key)) - np.repeat(head, np.diff(np.r_[head, len(key)]))
    out = key.copy()
    out[order] = np.where(serial > 0, W.mix(some.view(np.uint64) + serial.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), some)
    return out


def _symbols(scale):
    def run(batches):
        for batch in batches:
            data, at = W.utf8(batch.column(1))
            for i, j in W.chunks(at):
                h, first = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
                found = scale.value.look_up(h)[0].astype("<i2")
                texts = [found[first[k] : first[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(_apart(batch.column(0).slice(i, j - i).to_numpy())), pa.array(texts, pa.binary())], ["key", "symbols"])

    return run


def _trained(net, epochs: int, rate: float):
    """The network trained on from net on the texts of a group, and their tokens."""
    def run(group: pa.Table) -> pa.Table:
        own = Gru(net.value.symbols)
        own.load(net.value.flat())
        group = group.sort_by([("key", "ascending"), ("symbols", "ascending")])
        n = train(own, [np.frombuffer(t, "<i2") for t in group["symbols"].to_pylist()], epochs, rate=rate)
        return pa.table({"n": pa.array([n], pa.int64()), "net": pa.array([(n * own.flat().astype("<f8")).tobytes()], pa.binary())})

    return run


def _added(batches):
    """One row of a partition's networks, which are weighted by tokens."""
    n, total = 0, 0.0
    for batch in batches:
        for k, net in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n, total = n + k, total + np.frombuffer(net.as_buffer(), "<f8")
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "net"])


def fit(docs: DataFrame, scale: Scale) -> Gru:
    """The network fitted to all of docs (doc_id, text)."""
    net = Gru(scale.n_symbols)
    if not scale.n_texts:
        return net
    sc = docs.sparkSession.sparkContext
    rows = written(mapped(docs.select(F.xxhash64("doc_id", "text").alias("key"), "text"), _symbols(sc.broadcast(scale)), "key long, symbols binary"))
    rounds = ROUNDS if scale.n > PART else 1
    groups = max(1, round(scale.n / (PART * rounds)))
    rows = rows.withColumn("round", F.pmod("key", F.lit(rounds))).withColumn("group", F.pmod(F.floor(F.col("key") / rounds), F.lit(groups)))
    start = [(F.col("round") + F.col("group") == 0, 3 if rounds == groups == 1 else 1, 1e-2)]
    for which, epochs, rate in start + ([(F.col("round") == r, 1, 5e-3) for r in range(rounds)] if rounds * groups > 1 else []):
        task = _trained(sc.broadcast(net), epochs, rate)
        # sums of partitions, then of a few: what comes to the driver doesn't grow
        parts = mapped(rows.where(which).groupBy("group").applyInArrow(task, "n long, net binary"), _added, "n long, net binary")
        sums = mapped(parts.repartition(8), _added, "n long, net binary").collect()
        n = sum(r.n for r in sums)
        if n:
            net = Gru(scale.n_symbols)
            net.load(sum(np.frombuffer(r.net, "<f8") for r in sums) / n)
    return net


def learn(docs: DataFrame, known: int = KNOWN) -> tuple[DataFrame, Scale, Gru]:
    """The counts table, and the model fitted to docs (doc_id, text)."""
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    table_of = written(counts(docs))
    kinds = np.zeros((KINDS, 2), np.int64)
    for r in table_of.groupBy(F.col("word").bitwiseAND(KINDS - 1).alias("kind")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        kinds[r.kind] = r.n, r.v
    # the count from which on there are at most so many words; the histogram of counts is short
    cut, held = 1, 0
    for r in table_of.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).toLocalIterator():
        held += r.words
        if held > known:
            cut = r.c + 1
            break
    top = table_of.where(F.col("c") >= cut).toArrow()
    scale = Scale(list(zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True)), kinds, docs.count())
    return table_of, scale, fit(docs, scale)


def score(docs: DataFrame, table_of: DataFrame, scale: Scale, net: Gru) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    rows = mapped(docs.select("doc_id", text_or_empty().alias("text")), _scorer(sc.broadcast(scale), sc.broadcast(net)), SCORED)
    rows = written(rows)
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    found = rare.join(table_of, "word").groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_log"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = F.col("n_words") + 1
    end = float(np.log10(scale.n_texts + 1))
    base = F.col("base") + zero("rare_log") + F.lit(end) - n * F.lit(float(np.log10(scale.n + scale.v + 1)))
    model = F.col("model") / F.lit(float(np.log(10))) + F.col("other") + zero("rare_log")
    return rows.drop("rare", "rare_n").join(found, "row", "left").select(
        "doc_id",
        n.alias("n_tokens"),
        (F.col("known") + zero("rare_known") + F.lit(1 if scale.n_texts else 0)).alias("n_known"),
        F.lit(scale.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        model.alias("score"),
    )


def op8_gru_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_is(F.col("doc_id"), FOLDS, HELD_OUT)
    scored = score(docs, *learn(docs.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

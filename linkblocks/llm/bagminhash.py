"""Near duplicates by weighted Jaccard similarity of word shingles.

A text is the multiset of its five-word shingles (lower-case ASCII letters, words
between white space); a text of fewer words is one shingle of them all.

Signatures are BagMinHash: the weights of an element are covered by the intervals
[0,1), [1,2), [2,4), [4,8) ...; each interval carries a Poisson process with its
length as rate, drawn from the hash of element and interval, and each point has a
register and a weight level. A point counts if its level is below the element's
weight, a register keeps its earliest point, and an element is dropped as soon as
its process has passed all registers of the text. Registers of two texts then
agree with the probability sum(min) / sum(max) of their weights.

Bands of registers give buckets. Equal multisets are one candidate. In a bucket
all are compared with one leader, the member with the least draw; the draw depends
on the member alone, so a group has few leaders over all its buckets and a member
few pairs. Where a bucket still holds several components, they draw again, as long as
a round links one in ``WORTH`` of its pairs. What then is apart gets signatures of ``FINE``
registers, which are compared in numpy, all with all across components, in pairs of
blocks of ``BLOCK`` members; pairs that agree in ``MAYBE`` of them or more are
candidates too: of a text and another component the nearest pair alone where its
agreement is beyond doubt, else all; the nearest of each text are verified before
those that this leaves apart. So members of a group aren't paired with each other as
rows, and no co-bucketed texts of different components stay uncompared. Every link
is verified by the exact overlap of both multisets.

Edge cases: null, empty and white-space texts are one class; equal texts always
are; rows repeated under one id each get a row; a row without an id has the class of its
copies that have one, else none; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import hinted, mapped, table, text_or_empty, written

WORDS, LEAST = 5, 0.8
#: A pair at 0.8 shares a band with a chance of 0.9996.
BANDS, ROWS = 34, 7
#: Registers of the finer signatures of texts that leaders leave apart, and the shares of them
#: that must agree for a pair to be verified, and to be sure of it: 0.8 less and plus 3.5 standard deviations.
FINE = 1024
MAYBE, SURE = (LEAST + k * (LEAST * (1 - LEAST) / FINE) ** 0.5 for k in (-3.5, 3.5))
BLOCK = 1024
#: Pairs of one text that meet its copy in a task; a leader of more has several copies.
FOLLOWERS = 1000
#: Leaders are drawn again if at least one in so many pairs was a link.
WORTH = 4
#: Bytes of text in numpy at once.
STEP = 1 << 19
_MULT = W.mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bags(data: np.ndarray, at: np.ndarray, n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the distinct shingles of each row."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = W.hashes(data, starts, ends)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(first[1:], n) - np.arange(len(h))  # words from here to the end of the row
    s = h * _MULT[0]
    for j in range(1, n_words):
        s[: len(h) - j] += np.where(left[: len(h) - j] > j, h[j:] * _MULT[j], np.uint64(0))
    keep = left >= n_words
    short = (n > 0) & (n < n_words)
    keep[first[:-1][short]] = True
    s, row = W.mix(s[keep]), row[keep]
    key = W.mix(s + row.astype(np.uint64) * _GOLD)
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return row[order[head]], s[order[head]], np.diff(np.r_[head, len(key)])


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_rows: int, size: int = BANDS * ROWS) -> np.ndarray:
    """The earliest time in each register, inf for rows without elements."""
    out = np.full((n_rows, size), np.inf)
    # an element for each interval that its weight reaches
    n = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, weight = np.repeat(row, n), np.repeat(weight, n)
    key = W.mix(np.repeat(shingle, n) + (k.astype(np.uint64) + np.uint64(1)) * _MULT[20])
    low = np.where(k == 0, 0.0, 2.0 ** (k - 1))
    length = np.where(k == 0, 1.0, low)
    time, point = np.zeros(len(row)), 0
    flat, last = out.reshape(-1), np.full(n_rows, np.inf)
    while len(row):
        # a few elements get many points at once; points past the last register change nothing
        many = int(np.clip(20_000 // len(row), 1, 64))
        serial = np.arange(point + 1, point + 1 + many, dtype=np.uint64) * _GOLD
        point += many
        u = W.mix(key[:, None] + serial)
        v = W.mix(u + _MULT[21])
        gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        times = time[:, None] + np.cumsum(gap, 1) / length[:, None]
        level = low[:, None] + length[:, None] * ((v & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        ok = (level < weight[:, None]) & (times < last[row][:, None])
        place = row[:, None] * size + ((v >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(flat, place[ok], times[ok])
        if point < 8 or many > 1 or point % 8 == 0:
            last = out.max(1)
        time = times[:, -1]
        alive = time < last[row]
        row, key, low, length, weight, time = (x[alive] for x in (row, key, low, length, weight, time))
    return out


def bands(registers: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """One hash for each row and band."""
    parts = registers.view(np.uint64).reshape(len(registers), n_bands, -1)
    s = (parts * _MULT[: parts.shape[2]]).sum(2, dtype=np.uint64)
    return W.mix(s + W.mix(np.arange(n_bands, dtype=np.uint64)))


def _sums(row: np.ndarray, x: np.ndarray, n_rows: int) -> np.ndarray:
    out = np.zeros(n_rows, np.uint64)
    np.add.at(out, row, x)
    return out


SIGNED = "doc_id long, bag1 long, bag2 long, bands array<long>"


def _signed(batches):
    for batch in batches:
        ids, (data, at) = batch.column(0), W.utf8(batch.column(1))
        for i, j in W.chunks(at, STEP):
            row, s, w = bags(data[at[i] : at[j]], at[i : j + 1] - at[i])
            n = j - i
            bag1, bag2 = (_sums(row, W.mix(s + w.astype(np.uint64) * _MULT[k]), n) for k in (40, 41))
            some = np.zeros(n, bool)
            some[row] = True
            keys = bands(signatures(row, s, w, n)).view(np.int64)
            offsets = np.r_[0, np.cumsum(some * BANDS)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(bag1.view(np.int64)), pa.array(bag2.view(np.int64)), lists], ["doc_id", "bag1", "bag2", "bands"])


def _finely(batches):
    """Signatures of FINE registers of two bytes."""
    for batch in batches:
        ids, (data, at) = batch.column(0), W.utf8(batch.column(1))
        for i, j in W.chunks(at, STEP):
            registers = signatures(*bags(data[at[i] : at[j]], at[i : j + 1] - at[i]), j - i, FINE)
            short = (W.mix(registers.view(np.uint64)) >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([x.tobytes() for x in short], pa.binary())], ["doc_id", "registers"])


def overlap(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    """Weighted Jaccard similarity of row i of a with row i of b."""
    total = np.bincount(a[0], a[2], n) + np.bincount(b[0], b[2], n)
    key = np.r_[tuple(W.mix(s + r.astype(np.uint64) * _GOLD) for r, s, _ in (a, b))]
    row, weight = np.r_[a[0], b[0]], np.r_[a[2], b[2]]
    order = np.argsort(key, kind="stable")
    key = key[order]
    twin = np.flatnonzero(key[1:] == key[:-1])
    least = np.minimum(weight[order[twin]], weight[order[twin + 1]])
    both = np.bincount(row[order[twin]], least, n)
    return np.where(total > 0, both / np.maximum(total - both, 1), 1.0)


def _verified(batches):
    for batch in batches:
        (da, aa), (db, ab) = W.utf8(batch.column(2)), W.utf8(batch.column(3))
        for i, j in W.chunks(aa + ab, STEP):
            x = bags(da[aa[i] : aa[j]], aa[i : j + 1] - aa[i])
            y = bags(db[ab[i] : ab[j]], ab[i : j + 1] - ab[i])
            sim = overlap(x, y, j - i)
            keep = np.flatnonzero(sim >= LEAST)
            part = batch.slice(i, j - i).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim[keep])], ["a", "b", "similarity"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose multisets overlap by LEAST or more, with their similarity. pairs is a written table; b may be in any number of them."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.join(hinted(written(ids)), "doc_id", "left_semi")
    # a hot b is dealt out with copies of its text
    hot = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / FOLLOWERS).alias("copies")).where("copies > 1"))
    led = pairs.join(hinted(hot), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).alias("copy"))
    of = texts.join(hinted(hot), texts["doc_id"] == hot["b"], "left").select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    both = led.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(of, ["b", "copy"]).select("a", "b", "text_a", "text_b")
    return mapped(both, _verified, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b), label the least node of the component.

    Alternating large-star and small-star steps; each round is a written table.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = written(small)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def signed(docs: DataFrame) -> DataFrame:
    return mapped(docs, _signed, SIGNED)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for each row of docs (doc_id, text); class_id is the least id of the class."""
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    marks = written(signed(docs))
    reps = written(marks.groupBy("bag1", "bag2").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "bands")).alias("r")).select("bag1", "bag2", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands")))
    keyed = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = written(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    links, labels = None, None
    for turn in itertools.count():
        pairs = written(_led(shared, labels, turn))
        if pairs.isEmpty():
            break
        found = written(verified(pairs, docs).select("a", "b"))
        n = found.count()
        if n:
            links = found if links is None else written(links.unionByName(found))
            labels = components(links)
        if n * WORTH < pairs.count():
            break
    if links is None:
        links = shared.sparkSession.createDataFrame([], "a long, b long")
        labels = links.toDF("node", "label")
    second = written(_across(shared, labels, reps, docs))
    final = labels if second.isEmpty() else _joined(links, second, docs)
    classes = reps.join(final, reps["rep"] == final["node"], "left").select("bag1", "bag2", F.coalesce("label", "rep").alias("class_id"))
    return marks.select("doc_id", "bag1", "bag2").join(classes, ["bag1", "bag2"]).select("doc_id", "class_id")


def _labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of shared (key, rep, n, band) with the label of rep."""
    if labels is None:
        return shared.select("key", "rep", "n", "band", F.col("rep").alias("label"))
    return shared.join(labels, shared["rep"] == labels["node"], "left").select("key", "rep", "n", "band", F.coalesce("label", "rep").alias("label"))


def _led(shared: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Pairs (a, b) of a member and the leader b of one of its buckets, of different components."""
    seen = _labelled(shared, labels)
    leader = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("draw"), "rep", "label")).alias("leader")
    buckets = seen.groupBy("key").agg(leader, F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key", "leader")
    return seen.join(buckets, "key").where("label != leader.label").select(F.col("rep").alias("a"), F.col("leader.rep").alias("b")).distinct()


def _joined(links: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Labels after the pairs (a, b, near) are verified too: each text's nearest first, then those whose texts are still in different components."""
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("near", "b")).alias("b")).unionByName(pairs.groupBy("b").agg(F.max_by("a", F.struct("near", "a")).alias("a")).select("a", "b"))
    best = written(best.distinct())
    links = written(links.unionByName(verified(best, docs).select("a", "b")))
    labels = components(links)
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    rest = written(apart.join(best, ["a", "b"], "left_anti"))
    return labels if rest.isEmpty() else components(links.unionByName(verified(rest, docs).select("a", "b")))


def _across(shared: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b, near) of one bucket and of different components whose registers agree often enough; near is how many do."""
    seen = _labelled(shared, labels)
    split = seen.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    rest = written(seen.join(split, "key"))
    ids = hinted(written(rest.select(F.col("rep").alias("doc_id")).distinct()))
    fine = mapped(docs.join(ids, "doc_id", "left_semi"), _finely, "doc_id long, registers binary").groupBy("doc_id").agg(F.min("registers").alias("registers"))
    registers = written(fine.join(reps.select(F.col("rep").alias("doc_id"), "bands"), "doc_id"))
    # a member's block meets every block of its bucket: (x, y) with x <= y
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("rep"), blocks)
    rows = rest.select("key", "rep", "label", "band", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "label", "band")
    rows = rows.join(registers, rows["rep"] == registers["doc_id"]).select("key", "x", "y", "own", "rep", "label", "band", "registers", "bands")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return mapped(rows, _compared, "a long, b long, near long").distinct()


def _compared(batches):
    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if left is not None:
            t = pa.concat_tables([left, t])
        k = np.stack([t.column(i).to_numpy() for i in range(3)], 1)
        cut = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1]
        yield from (_block(t.slice(i, j - i)) for i, j in zip(cut[:-1], cut[1:], strict=True))
        left = t.slice(cut[-1]).combine_chunks()
    if left is not None and len(left):
        yield _block(left)


def _block(t: pa.Table) -> pa.RecordBatch:
    x, y = t.column(1)[0].as_py(), t.column(2)[0].as_py()
    own, rep, label = (t.column(i).to_numpy() for i in (3, 4, 5))
    band = t.column(6)[0].as_py()
    regs = np.frombuffer(b"".join(t.column(7).to_pylist()), "<u2").reshape(len(rep), -1)
    one = np.flatnonzero(own == x)
    two = one if x == y else np.flatnonzero(own == y)
    a, b, c = [], [], []
    keys = t.column(8).combine_chunks().flatten().to_numpy().reshape(len(rep), -1)[:, :band]
    least, sure = (int(np.ceil(x * regs.shape[1])) for x in (MAYBE, SURE))
    for i in one:
        other = two[(label[two] != label[i]) & ((rep[two] > rep[i]) | (x != y))]
        # a pair of several buckets is named in the first of them only
        other = other[~(keys[other] == keys[i]).any(1)]
        same = (regs[other] == regs[i]).sum(1)
        near, same = other[same >= least], same[same >= least]
        # by component, the nearest first
        order = np.lexsort((rep[near], -same, label[near]))
        near, same = near[order], same[order]
        head = np.r_[True, label[near][1:] != label[near][:-1]][: len(near)]
        top = same[np.flatnonzero(head)][np.cumsum(head) - 1]
        keep = head | (top < sure)
        near, same = near[keep], same[keep]
        a.append(np.maximum(rep[near], rep[i]))
        b.append(np.minimum(rep[near], rep[i]))
        c.append(same)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, c)], ["a", "b", "near"])


def op6_bagminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

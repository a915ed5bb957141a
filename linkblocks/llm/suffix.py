"""Exact removal of repeated byte strings of 400 bytes or more.

Strings of ``SHORT`` bytes that repeat, some fifty words, are found on the way and
reported, but not removed. Every window of ``SHORT`` bytes has an anchor: the
leftmost least hash of the 64-byte strings in it. Windows with one anchor form a
stretch of text, which goes on to the end of the ``LENGTH`` bytes from its last
window's start; each window is in exactly one, and equal windows have equal anchors
at equal places. So:

1. Stretches that are equal as a whole repeat all their windows; they are one string
   of the collection, known by two hashes of 64 bits, and one of each stands for all
   further on.
2. Of stretches with equal anchors that differ, those that occur once are laid
   side by side, aligned at the anchor, with one of each kind of the others. The
   collection's Burrows-Wheeler order and the lengths of common strings are then
   built column by column: each round takes one symbol of every stretch from the
   next part of a sequential file, moves the stretches to their new order and
   updates what each has in common with its neighbour. A window repeats if a
   neighbour shares its symbols. Because the stretches are aligned, it is
   the positional form of the transform: a round costs the number of stretches,
   not the number of all suffixes so far.
3. Each text loses the bytes that its repeated windows of ``LENGTH`` cover.

Only anchors are shuffled (one for about 100 bytes), and the bytes of the few
stretches of step 2. Stretches of one anchor go to one task. Their bytes go to a file
as they come, and the columns are made from it; in memory the task keeps some
numbers a stretch, about 150 bytes of them.

Edge cases: a null text is empty; texts under 400 bytes lose nothing; rows repeated
with the same id and text are separate texts, so both lose all windows; strings may
overlap within one text; rows without an id are texts
like others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import hinted, mapped, table, text_or_empty, written

LENGTH, SHORT, GRAM = 400, 256, 64
#: Grams of a short window.
SPAN = SHORT - GRAM + 1
#: Columns of aligned stretches: before and from the anchor on.
BEFORE = SHORT - GRAM
COLUMNS = BEFORE + LENGTH
HELD = 20_000
#: pos: first start of a window, and behind it, in ten bits each, the last start, the anchor and the end.
ANCHORS = "doc_id long, th long, pos long, gram long, whole long"
#: Most bytes of a table of stretches that is broadcast.
MOST = 64 << 20


def least_to_right(key: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(key[i : i + width]) for all i with that many."""
    n = len(key) - width + 1
    pad = -len(key) % width
    x = np.r_[key, np.full(pad, np.iinfo(key.dtype).max, key.dtype)].reshape(-1, width)
    ahead = np.minimum.accumulate(x, 1).reshape(-1)
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def packed(low, last, place, end):
    return low << 30 | last - low << 20 | place - low << 10 | end - low


def anchors(data: np.ndarray, at: np.ndarray):
    """(row, pos, gram, whole) of all stretches; places in bytes of the row, hashes of anchor and stretch."""
    n = len(data)
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    if n < SHORT:
        return empty
    p, q = W.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(W._BYTE[data] * p[:n], out=sums[1:], dtype=np.uint64)
    h = W.mix((sums[GRAM:] - sums[:-GRAM]) * q[: n - GRAM + 1])
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    best = (least_to_right(key, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each window, by its start
    # windows within a row only
    size = np.diff(at)
    count = np.maximum(size - SHORT + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    if not len(row):
        return empty
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + at[row]
    best = best[start]
    head = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (row[1:] != row[:-1])])
    tail = np.r_[head[1:], len(row)] - 1
    low, high, place, row = start[head], start[tail], best[head], row[head]
    end = np.minimum(high + LENGTH, at[row + 1])
    whole = W.mix((sums[end] - sums[low]) * q[low] + (end - low).astype(np.uint64))
    base = at[row]
    return row, packed(low - base, high - base, place - base, end - base), h[place].view(np.int64), whole.view(np.int64)


def _anchored(batches):
    for batch in batches:
        ids, th, (data, at) = batch.column(0), batch.column(1), W.utf8(batch.column(2))
        for i, j in W.chunks(at):
            row, *cols = anchors(data[at[i] : at[j]], at[i : j + 1] - at[i])
            if len(row):
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([ids.take(take), th.take(take), *map(pa.array, cols)], ["doc_id", "th", "pos", "gram", "whole"])


def _cut(batches):
    """The bytes of wanted stretches: (text, list of them) to rows, some thousand at a time."""
    for batch in batches:
        (data, at), wanted = W.utf8(batch.column(2)), batch.column(3)
        ends = wanted.offsets.to_numpy()
        items = wanted.values
        row = np.repeat(np.arange(len(wanted)), np.diff(ends))
        gram, pos = (items.field(k).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for k in range(2))
        for i in range(0, len(row), 2000):
            k = slice(i, i + 2000)
            start, size = at[row[k]] + (pos[k] >> 30), pos[k] & 1023
            stop = np.cumsum(size)
            pick = np.repeat(start - stop + size, size) + np.arange(stop[-1])
            piece = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, stop].astype(np.int32)), pa.py_buffer(data[pick])])
            take = pa.array(row[k])
            yield pa.RecordBatch.from_arrays([pa.array(gram[k]), batch.column(0).take(take), batch.column(1).take(take), pa.array(pos[k]), piece], ["gram", "doc_id", "th", "pos", "piece"])


class Collection:
    """Aligned stretches: their bytes in a file, row after row as they come."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()
        self.first: list[np.ndarray] = []
        self.last: list[np.ndarray] = []

    def __len__(self) -> int:
        return sum(map(len, self.first))

    def add(self, data: np.ndarray, ends: np.ndarray, offset: np.ndarray):
        """Stretches data[ends[i] : ends[i + 1]]; offset: place of the anchor in each."""
        first, size = BEFORE - offset, np.diff(ends)
        for i in range(0, len(size), 4096):
            n = size[i : i + 4096]
            block = np.zeros((len(n), COLUMNS), np.uint8)
            row = np.repeat(np.arange(len(n)), n)
            block[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[i : i + 4096][row]] = data[ends[i] : ends[i + len(n)]]
            self.file.write(block.tobytes())
        self.first.append(first)
        self.last.append(first + size)

    def columns(self, out) -> np.ndarray:
        """The file out with all symbols of the first column, then those of the second ..."""
        self.file.flush()
        m = len(self)
        rows = np.memmap(self.file, np.uint8, "r", shape=(m, COLUMNS))
        out.truncate(COLUMNS * m)
        view = np.memmap(out, np.uint8, "r+", shape=(COLUMNS, m))
        for i in range(0, m, 4096):
            view[:, i : i + 4096] = rows[i : i + 4096].T
        view.flush()
        return view

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, first, last start, length) of runs of windows of LENGTH and SHORT that another stretch has at the same place from the anchor."""
        m = len(self)
        first, last = np.concatenate(self.first), np.concatenate(self.last)
        found: list[tuple[np.ndarray, ...]] = []
        with tempfile.TemporaryFile() as file:
            view = self.columns(file)
            order = np.arange(m)
            since = np.zeros(m, np.int64)  # column from which each has all in common with the one before it
            state = {n: (np.zeros(m, bool), np.zeros(m, np.int32)) for n in (LENGTH, SHORT)}
            for c in range(COLUMNS):
                symbol = view[c][order].astype(np.int16)
                symbol[(c < first[order]) | (c >= last[order])] = 256
                move = np.argsort(symbol, kind="stable")
                most = _range_most(since, move)
                symbol, order = symbol[move], order[move]
                since = np.where(np.r_[False, symbol[1:] == symbol[:-1]] & (symbol < 256), most, c + 1)
                for n, (before, begin) in state.items():
                    if c + 1 < n:
                        continue
                    ok = since <= c + 1 - n
                    now = np.zeros(m, bool)
                    now[order[ok | np.r_[ok[1:], False]]] = True
                    begin[now & ~before] = c + 1 - n
                    over = np.flatnonzero(before & ~now)
                    if len(over):
                        found.append((over, begin[over] - first[over], c - n - first[over], np.full(len(over), n)))
                    before[:] = now
            for n, (before, begin) in state.items():
                over = np.flatnonzero(before)
                found.append((over, begin[over] - first[over], COLUMNS - n - first[over], np.full(len(over), n)))
            del view
        self.file.close()
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))


def _range_most(since: np.ndarray, move: np.ndarray) -> np.ndarray:
    """For each of the new order the largest of since from behind its new neighbour's old place to its own."""
    lo, hi = np.r_[move[0], move[:-1]] + 1, move + 1
    out = since[move]
    far = np.flatnonzero(hi - lo > 1)
    if not len(far):
        return out
    lo, hi = lo[far], hi[far]
    level = np.frexp((hi - lo).astype(float))[1] - 1
    step, row = 0, since
    for k in range(int(level.max()) + 1):
        now = level == k
        if now.any():
            out[far[now]] = np.maximum(row[lo[now]], row[hi[now] - (1 << k)])
        step = 1 << k
        if len(row) <= step:
            break
        row = np.maximum(row[:-step], row[step:])
    return out


def _ordered(batches):
    """Sorted by gram: runs groups together, some ten thousand stretches at a time, a group never in two parts."""
    held, names, gram = Collection(), [], None

    def out() -> pa.RecordBatch:
        which, begin, end, n = held.repeated()
        th, pos = (np.concatenate([x[k] for x in names]) for k in (1, 2))
        ids = pa.concat_arrays([x[0] for x in names]).take(pa.array(which))  # may be null
        low = pos[which] >> 30
        stop = low + end + n
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in (th[which], low + begin, np.where(n == LENGTH, stop, 0), np.where(n == SHORT, stop, 0)))], ["doc_id", "th", "begin", "long_end", "short_end"])

    for batch in batches:
        grams = batch.column(0).to_numpy()
        # a group that goes on in the next batch is kept together
        cut = int(np.searchsorted(grams, grams[-1])) if len(grams) else 0
        for i, j in ((0, cut), (cut, len(grams))):
            if i == j:
                continue
            if len(held) >= HELD and grams[i] != gram:
                yield out()
                held, names = Collection(), []
            ids, th, pos = batch.column(1).slice(i, j - i), *(batch.column(k).slice(i, j - i).to_numpy() for k in (2, 3))
            piece = batch.column(4).slice(i, j - i)
            ends = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset : piece.offset + len(piece) + 1]
            held.add(np.frombuffer(piece.buffers()[2], np.uint8), ends.astype(np.int64), pos >> 10 & 1023)
            names.append((ids, th, pos))
            gram = grams[j - 1]
    if names:
        yield out()


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(runs):
        if out and b <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((b, e))
    return out


def _removed(batches):
    for batch in batches:
        (data, at), runs = W.utf8(batch.column(1)), batch.column(2).to_pylist()
        raw = data.tobytes()
        n_removed, n_spans, sha, n_copied = [], [], [], []
        for k, pairs in enumerate(runs):
            a, done, kept = int(at[k]), 0, hashlib.sha256()
            spans = _merged([(r["begin"], r["long_end"]) for r in pairs or () if r["long_end"]])
            for b, e in spans:
                kept.update(raw[a + done : a + b])
                done = e
            kept.update(raw[a + done : int(at[k + 1])])
            n_removed.append(sum(e - b for b, e in spans))
            n_spans.append(len(spans))
            sha.append(kept.hexdigest())
            n_copied.append(sum(e - b for b, e in _merged([(r["begin"], r["short_end"]) for r in pairs or () if r["short_end"]])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(n_copied, pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_copied"])


def _with(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """texts joined with what was found in them, by id, which may be null, and hash."""
    found = found.withColumnsRenamed({"doc_id": "of", "th": "of_th"})
    return texts.join(found, (F.col("th") == F.col("of_th")) & F.col("doc_id").eqNullSafe(F.col("of")), how).drop("of", "of_th")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, th, begin, long_end, short_end): stretches of bytes that repeated windows of LENGTH and of SHORT cover, 0 for an end if there is none; overlapping ones aren't merged. th is the hash of the text."""
    named = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = written(mapped(named, _anchored, ANCHORS))
    # the hash of the whole takes in its length, and equal stretches have their anchors at one place
    kind = ["whole", "gram"]
    kinds = written(found.groupBy(*kind).agg(F.min(F.struct("doc_id", "th", "pos")).alias("one"), F.count("*").alias("n")))
    # whole stretches that occur again
    often = found.join(kinds.where("n > 1").select(*kind), kind, "left_semi")
    low, bits = F.shiftright("pos", 30), lambda k: F.shiftright("pos", k).bitwiseAND(1023)
    whole = often.select("doc_id", "th", low.alias("begin"), F.when(bits(0) >= LENGTH, low + bits(0)).otherwise(0).alias("long_end"), (low + bits(20) + SHORT).alias("short_end"))
    # anchors of several kinds of stretches, at least one of which occurs once
    same = Window.partitionBy("gram")
    mixed = kinds.withColumn("kinds", F.count("*").over(same)).withColumn("least", F.min("n").over(same)).where("kinds > 1 and least = 1")
    wanted = mixed.select("gram", "one.*")
    lists = written(wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("gram", "pos")).alias("wanted")))
    pieces = _with(named, hinted(lists, MOST, 64 + 24 * F.size("wanted")), "inner").select("doc_id", "th", "text", "wanted")
    # rows repeated under one id and text are one here: their stretches aren't of those that occur once
    pieces = mapped(pieces, _cut, "gram long, doc_id long, th long, pos long, piece binary").repartition("gram").dropDuplicates(["gram", "doc_id", "th", "pos"])
    parts = mapped(pieces.sortWithinPartitions("gram"), _ordered, "doc_id long, th long, begin long, long_end long, short_end long")
    return whole.unionByName(parts)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_copied) for each row of docs (doc_id, text); n_copied: bytes covered by repeated strings of SHORT bytes, which stay."""
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    runs = repeats(docs).groupBy("doc_id", "th").agg(F.collect_set(F.struct("begin", "long_end", "short_end")).alias("runs"))
    both = _with(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), runs, "left").select("doc_id", "text", "runs")
    return mapped(both, _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_copied long")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))

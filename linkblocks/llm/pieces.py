"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are cut at white space into words with the space before them; each distinct
word of a worker is segmented once, as long as it is kept. Hashes of all substrings
of all new words are probed in the sorted piece keys; words of equal length then
advance together through the positions, and the maximum over the pieces that end at
a position stores the backpointer. Words of over ``LONG`` characters advance one by
one, in time that grows with their length. For a unigram model the score of a path is the sum of its pieces.
For a BPE model, where the sum of scores isn't what decides, a path scores by
whether each of its neighbouring pieces is one that merging by rank would leave
side by side; exactly one piece that ends at a position is, so the path is the
segmentation of the merges.

The model file is read here; it must have identity normalisation and no piece
that holds white space (or a space mark behind other characters). A space mark
U+2581 that is in a text goes to byte pieces, so decoding is exact for any text.

Edge cases: null and empty texts have no pieces and decode to an empty text;
characters without a piece go to bytes; repeated rows each get a row; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import importlib.util
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import mapped, table, text_or_empty

MARK = "▁"
#: What words are cut at. Not the carriage return: pieces may hold it.
CUTS = W.SPACE.copy()
CUTS[13] = False
START, NONE = -2, -1
#: Words kept in a worker; beyond it those that were met again stay, at most half as many.
CACHED = 400_000
#: Longest word that advances with others of its length.
LONG = 255
#: Bytes of text in numpy at once.
STEP = 1 << 19


def default_model() -> str:
    spec = importlib.util.find_spec("public_tokenizers")
    base = spec.submodule_search_locations[0] if spec else "/opt/tokenizers"
    return f"{base}/piece_bpe_32k.model"


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message."""
    def varint(i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            b = data[i]
            x |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return x, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = data[i : i + n], i + n
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray  # 1 normal, 2 unknown, 3 control, 6 byte
    bpe: bool

    def __post_init__(self):
        self.byte = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kinds == 6):
            self.byte[int(self.pieces[i][3:5], 16)] = i
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces")
        self.ids = {self.pieces[i]: int(i) for i in np.flatnonzero(self.kinds == 1)}
        self.runs = {p for p in self.ids if set(p) == {MARK}}
        if any(c in " \t\n\v\f" or c == MARK and i and p not in self.runs for p in self.ids for i, c in enumerate(p) if len(p) > 1):
            raise ValueError("a piece of this model holds white space or an inner space mark")
        self.longest = max(len(p) for p in self.ids if p not in self.runs or p == MARK)
        self.rank = np.zeros(len(self.pieces), np.int64)  # in order of merging, single characters first
        usable = [p for p in self.ids if p not in self.runs or p == MARK]
        for r, p in enumerate(sorted(usable, key=lambda p: (len(p) > 1, -self.scores[self.ids[p]]))):
            self.rank[self.ids[p]] = r
        self.split: dict[int, tuple[int, int]] = {}
        if self.bpe:
            for p in usable:
                if len(p) > 1 and (pair := self._merged(list(p))):
                    self.split[self.ids[p]] = pair
            usable = [p for p in usable if len(p) == 1 or self.ids[p] in self.split]
        self.joined = {pair: i for i, pair in self.split.items()}
        keys = _text_keys(usable)
        order = np.argsort(keys)
        self.keys, self.of_key = keys[order], np.array([self.ids[p] for p in usable], np.int64)[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.bytes = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace(MARK, " ").encode() if k == 1 else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]

    def _merged(self, s: list[str]) -> tuple[int, int] | None:
        """The last two pieces that become this one, or None if merging ends elsewhere."""
        while len(s) > 2:
            best = max(range(len(s) - 1), key=lambda i: (self.scores[self.ids[s[i] + s[i + 1]]] if s[i] + s[i + 1] in self.ids else -np.inf, -i))
            if s[best] + s[best + 1] not in self.ids:
                return None
            s[best : best + 2] = [s[best] + s[best + 1]]
        return (self.ids[s[0]], self.ids[s[1]]) if s[0] in self.ids and s[1] in self.ids else None

    def stays(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b side by side: undoes their merges from the last one and looks for one across the border that comes earlier."""
        rank, joined, split = self.rank, self.joined, self.split
        limit = 1 << 60
        while True:
            m = joined.get((a, b))
            if m is not None and rank[m] < limit:
                return False
            if (rank[a] > rank[b] and a in split) or b not in split:
                if a not in split:
                    return True
                limit, a = rank[a], split[a][1]
            else:
                limit, b = rank[b] + 1, split[b][0]

    def run(self, n: int) -> list[int]:
        """Pieces of n space marks in a row."""
        sizes = {len(p) for p in self.runs}
        if not self.bpe:
            best: list[tuple[float, int]] = [(0.0, 0)]
            for j in range(1, n + 1):
                best.append(max((best[j - k][0] + float(self.scores[self.ids[MARK * k]]), k) for k in sizes if k <= j))
            out = []
            while n:
                out.append(self.ids[MARK * best[n][1]])
                n -= best[n][1]
            return out[::-1]
        # the best merge first, of equal ones the leftmost
        size, after, before, alive = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        score = {k: -float(self.scores[self.ids[MARK * k]]) for k in sizes}
        can = [(score[2], i, 2) for i in range(n - 1)] if 2 in sizes else []
        while can:
            _, i, total = heapq.heappop(can)
            j = after[i]
            if not alive[i] or j >= n or size[i] + size[j] != total:
                continue
            size[i], alive[j], after[i] = total, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (more := total + size[after[i]]) in sizes:
                    heapq.heappush(can, (score[more], i, more))
            if before[i] >= 0 and (more := total + size[before[i]]) in sizes:
                heapq.heappush(can, (score[more], before[i], more))
        return [self.ids[MARK * k] for k, ok in zip(size, alive, strict=True) if ok]


def load(path: str) -> Model:
    """Reads a model file; the path may be any that Spark's driver can open."""
    pieces, scores, kinds, bpe, charsmap = [], [], [], False, b""
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            pieces.append(x[1].decode())
            scores.append(float(np.frombuffer(x[2], "<f4")[0]) if 2 in x else 0.0)
            kinds.append(x.get(3, 1))
        elif number == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            charsmap = dict(_fields(value)).get(2, b"")
    if charsmap:
        raise ValueError("only models with identity normalisation are read")
    return Model(pieces, np.array(scores), np.array(kinds), bpe)


_A = np.uint64(0x9E3779B97F4A7C15)


_B = np.uint64(0xD6E8FEB86659FD93)


def _sums(points: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of code points."""
    p, _ = W.powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(W.mix(points.astype(np.uint64) + _A) * p[: len(points)], out=sums[1:], dtype=np.uint64)
    return sums


def _key(sums: np.ndarray, i: np.ndarray, size: int) -> np.ndarray:
    """Of the substrings of this size that begin at i."""
    return (sums[i + size] - sums[i]) * W.powers(len(sums))[1][i] + np.uint64(size * int(_A) % (1 << 64))


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _text_keys(texts: list[str]) -> np.ndarray:
    size = np.array([len(t) for t in texts], np.int64)
    sums, begin = _sums(_points(texts)), np.cumsum(size) - size
    out = np.zeros(len(texts), np.uint64)
    for n in np.unique(size):
        out[size == n] = _key(sums, begin[size == n], int(n))
    if len(np.unique(out)) < len(out):
        raise AssertionError("two pieces have one key")
    return out


class Segmenter:
    """Words to pieces, with what has been found before."""

    def __init__(self, model: Model):
        self.model = model
        self.pair_key = np.full(1 << 20, -1, np.int64)
        self.pair_ok = np.zeros(1 << 20, bool)
        self.chars = {p for p in model.ids if len(p) == 1}
        self.runs: dict[int, list[int]] = {}
        self.reset()

    def reset(self):
        #: where a word may be: its key and entry, by a hash of the key
        self.slot_key, self.slot_entry = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -1, np.int32)
        self.gaps: dict = {}
        self.flat, self.at, self.hits = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.n = 0

    def tidy(self):
        """Keeps of too many entries those that were met again."""
        if self.n <= CACHED:
            return
        slots = np.flatnonzero(self.slot_entry >= 0)
        entry, key = self.slot_entry[slots].astype(np.int64), self.slot_key[slots]
        hits = self.hits[entry]
        keep = np.argsort(-hits, kind="stable")[: CACHED // 2]
        keep = keep[hits[keep] > 1]
        flat, ends = ragged(self.flat, self.at, entry[keep])
        self.reset()
        first = self.add_all(flat, ends)
        self.place(key[keep], first + np.arange(len(keep)))

    def place(self, keys: np.ndarray, entries: np.ndarray):
        slot = (keys * _B >> np.uint64(44)).astype(np.int64)
        self.slot_key[slot], self.slot_entry[slot] = keys, entries

    def look_up(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Entries of words, -1 where there is none."""
        slot = (keys * _B >> np.uint64(44)).astype(np.int64)
        out = np.where(self.slot_key[slot] == keys, self.slot_entry[slot], -1).astype(np.int64)
        ok = out >= 0
        self.hits[out[ok]] += np.minimum(times[ok], 1 << 20).astype(np.int32)
        return out

    def add(self, ids) -> int:
        return self.add_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))

    def add_all(self, ids: np.ndarray, ends: np.ndarray) -> int:
        """Entries ids[ends[i] : ends[i + 1]]; returns the number of the first."""
        a, first = self.at[self.n], self.n
        while a + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while first + len(ends) > len(self.at):
            self.at, self.hits = np.r_[self.at, np.zeros_like(self.at)], np.r_[self.hits, np.zeros_like(self.hits)]
        self.flat[a : a + len(ids)] = ids
        self.n += len(ends) - 1
        self.at[first + 1 : self.n + 1] = a + ends[1:]
        self.hits[first : self.n] = 1
        return first

    def segment(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words in their order, and where each word's begin; words are of characters that have pieces, with a space mark at most at their beginning."""
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size) - size
        if not size.sum():
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        at, long, piece = self._probed(_points(texts), size)
        word = np.searchsorted(begin, at, "right") - 1
        while_empty = size[word] == 0  # a word without characters begins where the next one does
        if while_empty.any():
            some = np.flatnonzero(size)
            word = some[np.searchsorted(begin[some], at, "right") - 1]
        last, back = self._advanced(word, at - begin[word], long, piece, size, begin)
        return self._walked(last, back, size, begin + np.arange(len(size)))

    def _probed(self, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, piece) of all pieces in words that lie one after the other."""
        m, sums = self.model, _sums(points)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # to the end of the word
        found = []
        i = np.arange(len(points))
        for n in range(1, min(int(size.max()), m.longest) + 1):
            i = i[left[i] >= n]
            key = _key(sums, i, n)
            some = np.flatnonzero(m.maybe[(key >> np.uint64(42)).astype(np.int64)])
            key = key[some]
            k = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
            hit = m.keys[k] == key
            found.append((i[some[hit]], np.full(int(hit.sum()), n), m.of_key[k[hit]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _advanced(self, word, start, long, piece, size, begin):
        """The last piece and its size at each position of each word; words have a place more than characters."""
        slots = begin + np.arange(len(size))
        last = np.full(int(size.sum()) + len(size), NONE, np.int64)
        back, best = np.zeros(len(last), np.int32), np.full(len(last), -np.inf)
        last[slots], best[slots] = START, 0
        short = size[word] <= LONG
        end = start + long
        # by length of the word, then by position; larger pieces first, so that of equal ones the smallest is stored last
        key = (size[word[short]] << 8 | end[short]).astype(np.uint16)
        order = np.flatnonzero(short)[::-1][np.argsort(key[::-1], kind="stable")]
        key = np.sort(key, kind="stable")
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        base = slots[word]
        for i, j in itertools.pairwise([*cut.tolist(), len(key)]):
            k = order[i:j]
            a, b = last[base[k] + start[k]], piece[k]
            k, a, b = (x[a != NONE] for x in (k, a, b))
            to = base[k] + end[k]
            score = self._staying(a, b) if self.model.bpe else best[base[k] + start[k]] + self.model.scores[b]
            np.maximum.at(best, to, score)
            win = (score == best[to]) & (score > -np.inf)
            last[to[win]], back[to[win]] = b[win], long[k[win]]
        for w in np.flatnonzero(size > LONG):
            k = np.flatnonzero(word == w)
            k = k[np.argsort(start[k], kind="stable")]
            self._one(last, back, int(slots[w]), int(size[w]), start[k].tolist(), long[k].tolist(), piece[k].tolist())
        ends = slots + size
        if (last[ends] == NONE).any():
            raise AssertionError("a word has no segmentation")
        return last, back

    def _one(self, last, back, slot: int, n: int, starts: list[int], sizes: list[int], pieces: list[int]):
        """The same for one long word, whose pieces are in order of their starts."""
        bpe, scores, stays = self.model.bpe, self.model.scores, self.model.stays
        near, size, best = [NONE] * (n + 1), [0] * (n + 1), [-np.inf] * (n + 1)
        near[0], best[0] = START, 0.0
        known: dict[tuple[int, int], bool] = {}
        for i, k, b in zip(starts, sizes, pieces, strict=True):
            a = near[i]
            if a == NONE:
                continue
            if bpe:
                if near[i + k] != NONE:
                    continue
                ok = a == START or known.get((a, b))
                if ok is None:
                    ok = known[a, b] = stays(a, b)
                if ok:
                    near[i + k], size[i + k] = b, k
            elif best[i] + scores[b] > best[i + k]:
                best[i + k], near[i + k], size[i + k] = best[i] + scores[b], b, k
        last[slot : slot + n + 1], back[slot : slot + n + 1] = near, size

    def _walked(self, last, back, size, slots) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all words one after the other, and where each word's begin."""
        place, alive, steps = size.copy(), np.flatnonzero(size), []
        while len(alive) > 64:
            here = slots[alive] + place[alive]
            steps.append((alive, last[here]))
            place[alive] -= back[here]
            alive = alive[place[alive] > 0]
        for w in alive:  # a few long ones
            slot, j, found = int(slots[w]), int(place[w]), []
            pieces, sizes = last[slot : slot + j + 1].tolist(), back[slot : slot + j + 1].tolist()
            while j:
                found.append(pieces[j])
                j -= sizes[j]
            steps.append((np.full(len(found), w), np.array(found, np.int64)))
        word, piece = (np.concatenate(x) for x in zip(*steps, strict=True))
        count = np.bincount(word, minlength=len(size))
        ends = np.r_[0, np.cumsum(count)]
        # pieces were found from the last one of each word on
        order = np.argsort(word, kind="stable")
        out = np.empty(len(word), np.int64)
        w = word[order]
        out[ends[w] + ends[w + 1] - 1 - np.arange(len(w))] = piece[order]
        return out, ends

    def _staying(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """1 where piece b may follow a, else -inf."""
        key = a << 32 | b
        slot = (key.astype(np.uint64) * _B >> np.uint64(44)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = (self.pair_key[slot] != key) & (a != START)
        if new.any():
            some, inverse = np.unique(key[new], return_inverse=True)
            found = np.array([self.model.stays(x >> 32, x & 0xFFFFFFFF) for x in some.tolist()])
            ok[new] = found[inverse]
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], ok[new]
        return np.where(ok | (a == START), 1, -np.inf)

    def mixed(self, text: str) -> tuple[list[str], list]:
        """The parts of a word between characters without a piece, and how to put their pieces together."""
        parts, plan, cur = [], [], ""
        for i, c in enumerate(text):
            if c in self.chars and not (c == MARK and i):
                cur += c
            else:
                if cur:
                    plan.append(len(parts))
                    parts.append(cur)
                    cur = ""
                plan.append([int(self.model.byte[x]) for x in c.encode()])
        if cur:
            plan.append(len(parts))
            parts.append(cur)
        return parts, plan

    def words(self, keys: np.ndarray, texts: list[str]) -> np.ndarray:
        """Adds words and returns their entries."""
        known = self.chars.issuperset
        plain = np.array([known(t) and t.rfind(MARK) < 1 for t in texts], bool)
        out = np.zeros(len(texts), np.int64)
        k = np.flatnonzero(plain)
        out[k] = self.add_all(*self.segment([texts[i] for i in k])) + np.arange(len(k))
        rest = [(i, *self.mixed(texts[i])) for i in np.flatnonzero(~plain)]
        ids, ends = self.segment([x for _, parts, _ in rest for x in parts])
        first = 0
        for i, parts, plan in rest:
            out[i] = self.add(np.concatenate([ids[ends[first + x] : ends[first + x + 1]] if isinstance(x, int) else x for x in plan]))
            first += len(parts)
        self.place(keys, out)
        return out

    def gap(self, gap: bytes, joined: bool) -> list[int]:
        """Pieces of white space; joined: the last space belongs to the word behind it."""
        m, out = self.model, []
        if joined:
            gap = gap[:-1]
        for space, part in itertools.groupby(gap, lambda x: x == 32):
            part = list(part)
            out += self.run(len(part)) if space else [m.ids.get(chr(x), int(m.byte[x])) for x in part]
        return out

    def run(self, n: int) -> list[int]:
        if n > 4096:
            return self.model.run(n)
        if n not in self.runs:
            self.runs[n] = self.model.run(n)
        return self.runs[n]


def ragged(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[at[w]:at[w + 1]] for all w in which, and where each begins in the result."""
    n = at[which + 1] - at[which]
    ends = np.r_[0, np.cumsum(n)]
    return flat[np.repeat(at[which] - ends[:-1], n) + np.arange(ends[-1])], ends


def encode_rows(seg: Segmenter, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pieces of the rows, and where each row begins."""
    seg.tidy()
    n_rows = len(at) - 1
    some = np.diff(at) > 0
    data = np.insert(data, at[:-1][some], 32)  # the space before each text
    at = at + np.r_[0, np.cumsum(some)]
    starts, ends, first = W.spans(data, at, CUTS)
    n_words = np.diff(first)
    # gap k of a row lies before its word k; one more after the last word
    gap_row = np.repeat(np.arange(n_rows), n_words + 1)
    word_slot = np.arange(len(starts)) + np.repeat(np.arange(n_rows), n_words)
    g0, g1 = np.zeros(len(gap_row), np.int64), np.zeros(len(gap_row), np.int64)
    heads = np.r_[0, np.cumsum(n_words + 1)][:-1]
    g0[heads] = at[:-1]
    g0[word_slot + 1] = ends
    g1[word_slot] = starts
    g1[heads + n_words] = at[1:]
    spaced = np.zeros(len(starts), bool)
    ok = starts > 0
    spaced[ok] = (data[starts[ok] - 1] == 32) & (starts[ok] > at[gap_row[word_slot[ok]]])
    # words
    key = W.hashes(data, starts, ends) ^ np.where(spaced, np.uint64(1), np.uint64(0)) * _A
    some_keys, one, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    entry = seg.look_up(some_keys, times)
    new = np.flatnonzero(entry < 0)
    if len(new):
        raw, i = data.tobytes(), one[new]
        texts = [(MARK if s else "") + raw[a:b].decode() for s, a, b in zip(spaced[i].tolist(), starts[i].tolist(), ends[i].tolist(), strict=True)]
        entry[new] = seg.words(some_keys[new], texts)
    word_entry = entry[inverse.reshape(-1)]
    # a space that stays alone is part of the run before it
    alone = spaced & (seg.flat[seg.at[word_entry]] == seg.model.ids[MARK])
    bare = seg.at[word_entry] + alone
    joined = np.zeros(len(gap_row), bool)
    joined[word_slot] = spaced & ~alone
    size = g1 - g0
    gap_entry = np.full(len(gap_row), -1, np.int64)
    trivial = (size == 0) | ((size == 1) & joined)
    if "" not in seg.gaps:
        seg.gaps[""] = seg.add([])
    gap_entry[trivial] = seg.gaps[""]
    raw = None
    for k in np.flatnonzero(~trivial):
        raw = raw or data.tobytes()
        name = (raw[g0[k] : g1[k]], bool(joined[k]))
        e = seg.gaps.get(name, -1)
        if e < 0:
            e = seg.add(seg.gap(*name))
            if len(name[0]) < 64:
                seg.gaps[name] = e
        gap_entry[k] = e
    # gap, word, gap, word ... gap
    items = np.arange(len(gap_row)) + np.r_[0, np.cumsum(np.bincount(word_slot, minlength=len(gap_row)))][:-1]
    total = len(gap_row) + len(starts)
    lo, hi = np.zeros(total, np.int64), np.zeros(total, np.int64)
    lo[items], hi[items] = seg.at[gap_entry], seg.at[gap_entry + 1]
    lo[items[word_slot] + 1], hi[items[word_slot] + 1] = bare, seg.at[word_entry + 1]
    n = hi - lo
    ends_of = np.r_[0, np.cumsum(n)]
    ids = seg.flat[np.repeat(lo - ends_of[:-1], n) + np.arange(ends_of[-1])]
    return ids, ends_of[np.r_[items[heads], total]]


def decode_rows(model: Model, ids: np.ndarray, at: np.ndarray, tables={}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The bytes of the rows, without the space before each text, and where each row begins."""
    key = id(model)
    if key not in tables:
        tables[key] = np.frombuffer(b"".join(model.bytes), np.uint8), np.r_[0, np.cumsum([len(x) for x in model.bytes])]
    data, ends = ragged(*tables[key], ids.astype(np.int64))
    at = ends[at]
    some = np.diff(at) > 0
    return np.delete(data, at[:-1][some]), at - np.r_[0, np.cumsum(some)]


_SEGMENTERS: dict[str, Segmenter] = {}


def _coder(model_bytes: tuple, keep_ids: bool):
    name = model_bytes[0]

    def run(batches):
        if name not in _SEGMENTERS:
            _SEGMENTERS[name] = Segmenter(model_bytes[1])
        seg = _SEGMENTERS[name]
        for batch in batches:
            doc, (data, at) = batch.column(0), W.utf8(batch.column(1))
            for i, j in W.chunks(at, STEP):
                ids, ends = encode_rows(seg, data[at[i] : at[j]], at[i : j + 1] - at[i])
                back, ends2 = decode_rows(seg.model, ids, ends)
                raw, said = back.tobytes(), ids.astype("<i4").tobytes()
                text = data[at[i] : at[j]].tobytes()
                cols = [doc.slice(i, j - i), pa.array(np.diff(ends))]
                names = ["doc_id", "n_pieces"]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                same = [raw[ends2[k] : ends2[k + 1]] == text[at[i + k] - at[i] : at[i + k + 1] - at[i]] for k in range(j - i)]
                cols += [
                    pa.array([hashlib.sha256(said[4 * ends[k] : 4 * ends[k + 1]]).hexdigest() for k in range(j - i)]),
                    pa.array([hashlib.sha256(raw[ends2[k] : ends2[k + 1]]).hexdigest() for k in range(j - i)]),
                    pa.array(same, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(cols, [*names, "ids_sha256", "decoded_sha256", "same"])

    return run


def encode(docs: DataFrame, model_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids?, ids_sha256, decoded_sha256, same) for each row of docs (doc_id, text).

    ids_sha256 is over little-endian 32-bit ids; decoded_sha256 over the text that
    decoding the ids gives; same: that text is the input, byte for byte.
    """
    path = model_path or default_model()
    schema = f"doc_id long, n_pieces long, {'ids array<int>, ' if keep_ids else ''}ids_sha256 string, decoded_sha256 string, same boolean"
    return mapped(docs.select("doc_id", text_or_empty().alias("text")), _coder((path, load(path)), keep_ids), schema)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False)

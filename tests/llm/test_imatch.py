import hashlib
import itertools
import random
import re
import struct
from collections import Counter

import xxhash

from linkblocks.llm import imatch as I


def test_successors(spark):
    ids = [5, -3, 0, 511, 512, 513, 10**9, 10**9 + 1, 262144, 262143, 7]
    got = {r.doc_id: r.next_id for r in I.successors(spark.createDataFrame([(i,) for i in ids + ids], "doc_id long")).collect()}
    s = sorted(ids)
    assert got == dict(zip(s, s[1:] + s[:1], strict=True))


def test_edited_and_prints(spark):
    words = [f"t{i % 17} u{i % 5}é v{i}" for i in range(40)]
    rows = [(i * 3, " ".join(words[i : i + 9])) for i in range(30)] + [(200, None), (201, ""), (202, "ß"), (203, " ".join(words[3:12])), (204, "Ü日本 x")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, mask int, fingerprint string")
    got = {r.doc_id: r for r in I.fingerprints(df, low=0.05, high=0.6).collect()}
    assert len(got) == len(rows)
    texts = [(i, t or "") for i, t in rows]
    df_of = {}
    terms = lambda t: {w for w in re.split(r"[^\w]+", t.lower().replace("_", " ")) if w}
    for _, t in texts:
        for w in terms(t):
            df_of[w] = df_of.get(w, 0) + 1
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[1][:q]
        assert got[i].next_id == nxt[0]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        band = {w for w in terms(t) if 0.05 * len(rows) <= df_of[w] <= 0.6 * len(rows)}
        if not band:
            assert got[i].fingerprint == "text:" + hashlib.sha256(t.encode()).hexdigest()
        if e == t:
            assert got[i].fingerprint == got[i].edited_fingerprint
    assert got[9].fingerprint == got[203].fingerprint


def test_likeness(spark):
    rows = [("a.b.-", "a.c.-", 0.5), ("-.-.x", "-.-.x", 1.0), ("text:1", "text:1", 1.0), ("text:1", "a.-.-", 0.0), ("a.-.-", "-.b.-", 0.0)]
    df = spark.createDataFrame(rows, "x string, y string, want double")
    assert all(r.got == r.want for r in df.select("want", I.likeness(df.x, df.y).alias("got")).collect())


def test_empty(spark):
    assert I.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "aa bb cc dd"), (1, "aa bb cc dd"), (2, "aa cc ee ff")]
    got = I.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), low=0, high=1).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2] and len({r.fingerprint for r in got if r.doc_id == 1}) == 1


def x64(data, seed=42):
    """Spark's hash of bytes, or of a number, as a signed number."""
    raw = data if isinstance(data, bytes) else struct.pack("<q", data)
    return xxhash.xxh64_intdigest(raw, seed & (1 << 64) - 1)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows, low, high):
    """Fingerprint, edited fingerprint and both likenesses of (id, text) rows with different ids, from the definition."""
    rows = sorted((i, t or "") for i, t in rows)
    terms = lambda t: {signed(x64(w.encode())) for w in re.split(r"[^\w]|_", t.lower()) if w}
    df = Counter(x for _, t in rows for x in terms(t))
    n = len(rows)
    band = {x for x in df if max(1, low * n) <= df[x] <= max(1, high * n)}
    kept = [{x for x in band if signed(x64(struct.pack("<i", k), x64(x))) % (1 << I.SHIFTS[k % 4]) == 0} for k in range(I.SUBSETS)]

    def fingerprint(t):
        out = []
        for k in range(I.SUBSETS):
            some = sorted(terms(t) & kept[k])
            h = x64(struct.pack("<i", k))
            for x in some:
                h = x64(x, h)
            out.append(f"{h:x}" if some else "-")
        return ".".join(out) if any(x != "-" for x in out) else "text:" + hashlib.sha256(t.encode()).hexdigest()

    def like(a, b):
        a, b = a.split("."), b.split(".")
        some = [(x, y) for x, y in itertools.zip_longest(a, b) if x != "-" or y != "-"]
        return sum(x == y for x, y in some) / len(some)

    prints = [fingerprint(t) for _, t in rows]
    out = {}
    for k, (i, t) in enumerate(rows):
        q, after = len(t) // 4, rows[(k + 1) % n][1]
        e = fingerprint(t[: len(t) - q] + after[:q])
        out[i] = prints[k], e, like(prints[k], e), like(prints[k], prints[(k + 1) % n])
    return out


def test_query_equals_brute_force(spark, tmp_path):
    """Digests and likeness of the whole query at its own parameters; ids far apart, a long text, odd texts."""
    r = random.Random(8)
    words = [f"wort{i}" for i in range(900)]
    rows = [(r.randrange(-(1 << 62), 1 << 62), " ".join(r.choices(words, k=r.randrange(1, 60)))) for _ in range(150)]
    rows += [(i, rows[i][1]) for i in range(5)] + [(6, None), (7, ""), (8, "ß Ü"), (9, " ".join(r.choices(words, k=40_000)))]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, mask int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in I.op3_imatch(spark, str(tmp_path)).collect()}
    want = brute(rows, I.LOW, I.HIGH)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:2] == want[i][:2] and all(abs(a - b) < 1e-12 for a, b in zip(got[i][2:], want[i][2:], strict=True)), i

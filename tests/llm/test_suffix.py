import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np

from linkblocks.llm import suffix as S


def brute(texts, size=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + size] for x in raw for i in range(len(x) - size + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 2, bool)
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] > 1:
                gone[i + 1 : i + size + 1] = True
        out.append((len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone[1:-1]])).hexdigest()))
    return out


def made(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["über", "the", "x", "naïve", "lorem", "ipsum", "\n", "q" * 7, "日本"]) + str(r.randrange(400))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60), text(150), text(400)]
    texts = []
    for i in range(40):
        t = text(r.choice([0, 10, 70, 200, 600]))
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            a = r.randrange(len(s) // 2)
            cut = r.randrange(len(t) + 1)
            t = t[:cut] + s[a : a + r.randrange(300, 1500)] + t[cut:]
        if r.random() < 0.2 and texts:
            t = r.choice(texts)
            if r.random() < 0.5:
                t = t[:50] + "!" + t[50:]
        texts.append(t)
    return texts + [None, "", "a" * 399, "b" * 400, "c" * 401, "ab" * 700, "xyz " * 300 + "end", "line of text that repeats\n" * 90, "d" * 1000 + "e" * 1000]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        texts = made(seed)
        rows = [(i, t, 1, b"") for i, t in enumerate(texts)] + [(0, texts[0], 1, b""), (None, texts[5], 1, b""), (None, texts[6] + "!", 1, b"")]
        texts += [texts[0], texts[5], texts[6] + "!"]
        want = [(*w, x[1]) for w, x in zip(brute(texts), brute(texts, 256), strict=True)]
        got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, th int, piece binary")).collect()
        key = lambda x: (x[0] is None, x)
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_copied) for r in got), key=key) == sorted(((i, *w) for (i, *_), w in zip(rows, want, strict=True)), key=key)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_to_right():
    x = np.random.RandomState(0).randint(0, 99, 1000).astype(np.uint64)
    assert (S.least_to_right(x, 37) == [x[i : i + 37].min() for i in range(964)]).all()


def test_hot_anchor_is_read_from_files():
    """One passage in 50,000 surroundings: bytes of all of them are never in memory."""
    r = np.random.RandomState(3)
    m, gram = 50_000, r.randint(97, 123, 300).astype(np.uint8)
    tracemalloc.start()
    c = S.Collection()
    for i in range(0, m, 1000):
        n = 150
        data = r.randint(97, 123, (1000, 100 + 300 + n)).astype(np.uint8)
        data[:, 100:400] = gram
        data[::2, 390:] = data[0, 390:]  # and in half of each thousand one more that is shared
        c.add(data.reshape(-1), np.arange(1001) * data.shape[1], np.full(1000, 150))
    which, begin, end, length = c.repeated()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    short = which[length == S.SHORT]
    assert len(np.unique(short)) == m and (begin[length == S.SHORT] >= 90).sum() >= 0.9 * m
    assert set(which[length == S.LENGTH]) == set(range(0, m, 2))

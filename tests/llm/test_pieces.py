import random
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from linkblocks.llm import pieces as P
from linkblocks.llm import words as W

TEXTS = ["", " ", "  a", "Hello  wörld 日本語 \n x", "\n\n\ta b  \r\n c ", "aaaaaaaaa bbbb", "   ", "x" * 500, "ÀÈ 🤖🤖 \u0000 z", "the the the", "¿Qué? ▪", "a b   c", "(password=ab12)", "http://www.example.com/index.html?a=1&b=2", " " * 37 + "q", "hello" + " " * 18]


@pytest.fixture(scope="module")
def model():
    return P.load(P.default_model())


def test_ids_equal_the_library(model):
    lib = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    r = random.Random(3)
    syl = ["the", "ing", "er", "Ä", "ß", "é", "qu", "tion", "on", "an", "X", "7", ".", ",", "--", "st", "\n", "  ", " "]
    texts = TEXTS + ["".join(r.choice(syl) for _ in range(r.randrange(1, 60))) for _ in range(1500)]
    texts += ["".join(r.choice("abcdeé 中日\n") for _ in range(30)) for _ in range(300)]
    ids, at = P.encode_rows(P.Segmenter(model), *W.utf8(pa.array(texts)))
    bad = [(t, ids[at[i] : at[i + 1]].tolist(), lib.encode(t)) for i, t in enumerate(texts) if ids[at[i] : at[i + 1]].tolist() != lib.encode(t)]
    assert not bad, (len(bad), bad[:3])


def test_round_trip(model):
    texts = [*TEXTS, None, "▁", "a▁▁b ▁", "▁x"]
    data, at = W.utf8(pa.array(texts))
    ids, ends = P.encode_rows(P.Segmenter(model), data, at)
    back, ends2 = P.decode_rows(model, ids, ends)
    assert back.tobytes() == data.tobytes() and (ends2 == at).all()


def test_unigram_is_the_best_of_all_segmentations(model):
    r = random.Random(5)
    chars = "abc"
    toks = sorted({"".join(r.choice(chars) for _ in range(r.randrange(1, 4))) for _ in range(25)} | set(chars) | {P.MARK, P.MARK + "a"})
    names = [f"<0x{i:02X}>" for i in range(256)] + toks
    uni = P.Model(names, np.array([0.0] * 256 + [-r.uniform(1, 9) for _ in toks]), np.array([6] * 256 + [1] * len(toks)), False)
    seg = P.Segmenter(uni)

    def best(s):
        return max((uni.scores[uni.ids[s[:k]]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in uni.ids), default=-np.inf) if s else 0.0

    texts = ["".join(r.choice(chars) for _ in range(r.randrange(1, 10))) for _ in range(100)]
    flat, ends = seg.segment(texts)
    for t, ids in zip(texts, np.split(flat, ends[1:-1]), strict=True):
        assert "".join(uni.pieces[i] for i in ids) == t
        assert abs(uni.scores[ids].sum() - best(t)) < 1e-9


def test_query_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None, "hello", "hello"])], "doc_id long, text string, ids string")
    rows = P.encode(df).collect()
    assert len(rows) == len(TEXTS) + 3 and all(r.same and r.n_pieces == len(r.ids) for r in rows)
    assert P.encode(df.limit(0)).count() == 0


def test_long_words_and_spaces_take_seconds(model):
    r = random.Random(9)
    lib = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    seg = P.Segmenter(model)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(200_000)), "a" + " " * 200_000 + "b", "".join(r.choice("日本語中国的一是在") for _ in range(50_000)), "y" * 100_000, "q " * 100_000]
    began = time.process_time()
    ids, at = P.encode_rows(seg, *W.utf8(pa.array(texts)))
    assert time.process_time() - began < 30
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t)


def test_words_kept_are_few_and_right(model, monkeypatch):
    monkeypatch.setattr(P, "CACHED", 200)
    r = random.Random(4)
    seg = P.Segmenter(model)
    lib = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    for _ in range(20):
        texts = [" ".join("".join(r.choice("abcde") for _ in range(r.randrange(1, 5))) for _ in range(80)) for _ in range(4)]
        ids, at = P.encode_rows(seg, *W.utf8(pa.array(texts)))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(4)] == [lib.encode(t) for t in texts]
    assert seg.n < 1000

"""Language identification by a byte convolutional network.

A text's UTF-8 bytes (ASCII capitals lowered) are cut into windows of 128. Filters
of two, three and four bytes slide over one-hot bytes, each takes its maximum over
a window, and a softmax layer follows; a text's prediction is the softmax of the
mean logits of all its windows, weighted by their bytes. Training is numpy with
Adam on the driver, over a bounded sample: ``PER_LANG`` texts of each language,
chosen by a hash of their ids, and ``PER_TEXT`` windows of each.

Inputs of a prediction are bytes alone. Edge cases: a null text, or one without a
letter (Unicode), is ``und`` with score 0, as is everything where nothing could be
learnt; texts shorter than a window are padded; repeated rows each get a row;
extra columns are ignored; a null id is not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import mapped, table

WINDOW, FILTERS, WIDTHS = 128, 16, (2, 3, 4)
PER_LANG, PER_TEXT = 400, 4
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def fold_is(doc_id: Column, folds: int, value: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == value, F.lit(False))


def windows(data: np.ndarray, at: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows of all rows, and the number of windows of each row."""
    n = np.diff(at)
    count = -(-n // size)
    first = np.r_[0, np.cumsum(count)]
    out = np.zeros(first[-1] * size, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * size - at[:-1], n)] = W.LOWER[data]
    return out.reshape(-1, size), count


class Net:
    def __init__(self, n_out: int, seed: int = 1):
        r = np.random.RandomState(seed)
        self.k = [(r.randn(w, 256, FILTERS) * 0.1).astype(np.float32) for w in WIDTHS]
        self.b = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.w = (r.randn(len(WIDTHS) * FILTERS, n_out) * 0.1).astype(np.float32)
        self.c = np.zeros(n_out, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.k, self.b, self.w, self.c]

    def forward(self, x: np.ndarray):
        """Logits, and what a step back needs."""
        tops, at = [], []
        for w, k in zip(WIDTHS, self.k, strict=True):
            y = sum(k[j][x[:, j : x.shape[1] - w + 1 + j]] for j in range(w))
            p = y.argmax(1)
            at.append(p)
            tops.append(np.take_along_axis(y, p[:, None], 1)[:, 0])
        pre = np.concatenate(tops, 1) + self.b
        h = np.maximum(pre, 0)
        return h @ self.w + self.c, (x, at, pre, h)

    def step_back(self, d: np.ndarray, kept) -> list[np.ndarray]:
        x, at, pre, h = kept
        dh = (d @ self.w.T) * (pre > 0)
        grads = []
        rows = np.arange(len(x))[:, None]
        for i, (w, k) in enumerate(zip(WIDTHS, self.k, strict=True)):
            g = np.zeros_like(k)
            part = dh[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (x[rows, at[i] + j], np.arange(FILTERS)[None]), part)
            grads.append(g)
        return [*grads, dh.sum(0), h.T @ d, d.sum(0)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, n_out: int, steps: int = 600, batch: int = 64, rate: float = 5e-3, seed: int = 1) -> Net:
    net, r, t = Net(n_out, seed), np.random.RandomState(seed), 0
    m, v = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    for _ in range(-(-steps // -(-len(x) // batch))):
        order = r.permutation(len(x))
        for k in range(0, len(x), batch):
            pick = order[k : k + batch]
            logits, kept = net.forward(x[pick])
            d = softmax(logits)
            d[np.arange(len(pick)), y[pick]] -= 1
            t += 1
            for p, g, a, b in zip(net.parameters(), net.step_back(d / len(pick), kept), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


class Tables:
    """Filters as lookups of byte pairs, and the network's output from them."""

    def __init__(self, net: Net):
        k2, k3, k4 = net.k
        pair = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(65536, -1))
        self.two, self.three, self.four, self.four2 = pair(k2[0], k2[1]), pair(k3[0], k3[1]), pair(k4[0], k4[1]), pair(k4[2], k4[3])
        self.last, self.net = k3[2], net

    def logits(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.zeros((len(x), len(self.net.c)), np.float32)
        for i in range(0, len(x), block):
            b = x[i : i + block]
            p = b[:, :-1].astype(np.int32) << 8 | b[:, 1:]
            tops = [self.two.take(p, 0).max(1)]
            y = self.three.take(p[:, :-1], 0)
            y += self.last.take(b[:, 2:], 0)
            tops.append(y.max(1))
            y = self.four.take(p[:, :-2], 0)
            y += self.four2.take(p[:, 2:], 0)
            tops.append(y.max(1))
            out[i : i + block] = np.maximum(np.concatenate(tops, 1) + self.net.b, 0) @ self.net.w
        return out + self.net.c


def learn(docs: DataFrame, per_lang: int = PER_LANG, per_text: int = PER_TEXT) -> tuple[list[str], Net | None]:
    """Languages and the network, from the rows of docs (doc_id, text, lang) that have both and aren't held out."""
    labelled = docs.where("text is not null and lang is not null and text != ''").where(~fold_is(F.col("doc_id"), FOLDS, HELD_OUT))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # ids alone go through the window; texts of the chosen ones follow
    chosen = labelled.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang).select("doc_id", "lang").distinct()
    room = F.greatest(F.length("text") - WINDOW, F.lit(0))
    parts = F.array(*(F.substring(F.col("text"), (room * k / max(1, per_text - 1)).cast("int") + 1, F.lit(WINDOW)) for k in range(per_text)))
    rows = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", F.explode(F.array_distinct(parts)).alias("part")).toPandas()
    rows = rows.sort_values(["doc_id", "lang", "part"])
    langs = sorted(rows.lang.unique())
    if not langs:
        return [], None
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, t in enumerate(rows.part):
        b = np.frombuffer(t.encode()[:WINDOW], np.uint8)
        x[i, : len(b)] = W.LOWER[b]
    return langs, train(x, rows.lang.map({k: i for i, k in enumerate(langs)}).to_numpy(), len(langs))


def _predictor(langs: list[str], net: Net | None):
    def run(batches):
        tables = Tables(net) if net else None
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            (data, at), letters = W.utf8(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in W.chunks(at):
                n = j - i
                which, score = np.full(n, len(langs)), np.zeros(n)
                if tables:
                    x, count = windows(data[at[i] : at[j]], at[i : j + 1] - at[i])
                    size = np.diff(at[i : j + 1])
                    row = np.repeat(np.arange(n), count)
                    weight = np.minimum(WINDOW, size[row] - (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW)
                    logits = tables.logits(x).astype(np.float64) * weight[:, None]
                    mean = np.stack([np.bincount(row, logits[:, k], n) for k in range(len(langs))], 1) / np.maximum(size, 1)[:, None]
                    p = softmax(mean)
                    ok = letters[i:j]
                    which[ok], score[ok] = p.argmax(1)[ok], p.max(1)[ok]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(names[which], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, langs: list[str], net: Net | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return mapped(rows, _predictor(langs, net), "doc_id long, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, *learn(docs)).select("doc_id", fold_is(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")

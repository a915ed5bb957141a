"""Encoders of texts and graphs to vectors.

Pre-trained models come in as a (tok, vec) table of word vectors or as a batch
function; where no model is at hand, ``hash_vectors`` gives every token a fixed one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counts import counted, flat, frequent, lists, repeated_ids
from ..functions.lineage import settled, stored
from ..functions.text import Tokenizer, exploded_tokens, pattern_tokens
from .knn import mean_vectors

SCALE = float(1 << 28)


def hash_vector(name: Column, size: int) -> Column:
    """Numbers in [-1, 1) from MD5 of name and place."""
    one = lambda i: F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), i.cast("string")).cast("binary")), 1, 7), 16, 10).cast("double") / SCALE * 2 - 1
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def hash_vectors(tokens: DataFrame, size: int = 16) -> DataFrame:
    """(tok, vec) for the distinct tokens of a frame."""
    return tokens.select("tok").distinct().withColumn("vec", hash_vector(F.col("tok"), size))


def check_texts(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with one value column besides the id; null becomes empty."""
    out = []
    for side in (left, right):
        if len(side.columns) != 2:
            raise ValueError("texts have an id and one value column")
        k, v = side.columns
        out.append(side.select(F.col(f"`{k}`").cast("string").alias("id"), F.coalesce(F.col(f"`{v}`").cast("string"), F.lit("")).alias("text")))
    return out[0], out[1]


class Encoder:
    """``encode`` gives (name, vec) of both sides."""

    def encode(self, left: DataFrame, right: DataFrame, left_rel: DataFrame | None = None, right_rel: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        a, b = check_texts(left, right)
        rows = self.vectors(a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))))
        side = lambda k: rows.where(F.col("side") == k).select(F.col("id").alias("name"), "vec")
        return side(0), side(1)

    def vectors(self, texts: DataFrame) -> DataFrame:
        """(side, id, vec) of (side, id, text)."""
        raise NotImplementedError


def _keyed(texts: DataFrame) -> DataFrame:
    return texts.select(F.struct("side", "id").alias("id"), "text")


def _unkeyed(rows: DataFrame) -> DataFrame:
    return rows.select("id.side", "id.id", "vec")


class AverageEncoder(Encoder):
    """The mean of the vectors of known tokens; a text without any has a vector from its id."""

    def __init__(self, word_vectors: DataFrame | None = None, tokenizer: Tokenizer | None = None, size: int = 16):
        self.word_vectors, self.tokenizer, self.size = word_vectors, tokenizer, size

    def tokens(self, texts: DataFrame) -> DataFrame:
        """(id, tok) with duplicates; without a tokenizer neither case nor stop words matter."""
        if self.tokenizer:
            return exploded_tokens(texts, self.tokenizer, distinct=False)
        return texts.select("id", F.explode(pattern_tokens(F.col("text"))).alias("tok"))

    def weights(self, tokens: DataFrame) -> DataFrame | None:
        """(tok, weight), or None for 1."""
        return None

    def vectors(self, texts: DataFrame) -> DataFrame:
        texts = _keyed(texts)
        if self.word_vectors is None and not repeated_ids(texts):
            return _unkeyed(self.finished(*[self.hashed_means(texts)] * 2))
        tokens = self.tokens(texts)
        words = self.word_vectors if self.word_vectors is not None else hash_vectors(tokens, self.size)
        weights = self.weights(tokens)
        if weights is not None:
            words = words.join(weights, "tok", "left").select("tok", F.transform("vec", lambda x: x * F.coalesce("weight", F.lit(1.0))).alias("vec"))
        # a token is looked up once for each text, and weighs as often as it occurs
        rows = tokens.groupBy("id", "tok").agg(F.count("*").alias("n")).join(words, "tok")
        parts = rows.select("id", "n", F.posexplode("vec").alias("pos", "x")).groupBy("id", "pos").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
        means = parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
        return _unkeyed(self.finished(texts.select("id").join(means, "id", "left"), means))

    def weight(self, n: Column, total: int) -> Column:
        """Of a token that occurs n times among all."""
        return F.lit(1.0)

    def hashed_means(self, texts: DataFrame) -> DataFrame:
        """(id, vec), null without a token, of ids of one text each. Frequent tokens are added up where their text lies, the others after a shuffle of these alone."""
        spark, size = texts.sparkSession, self.size
        held = counted(texts, self.tokenizer.tokens(F.col("text")) if self.tokenizer else pattern_tokens(F.col("text")))
        total = held.agg(F.sum(F.aggregate("ns", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()[0] or 0
        numbers = F.transform(hash_vector(F.col("tok"), size), lambda x: F.round((x + 1) / 2 * SCALE).cast("int"))
        known = frequent(held).select("tok", (self.weight(F.col("n"), total) * 1.0).alias("weight"), numbers.alias("v")).toArrow()
        table = (known["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size) / SCALE * 2 - 1) * known["weight"].to_numpy()[:, None] if known.num_rows else np.zeros((1, size))
        given = spark.sparkContext.broadcast((known["tok"].combine_chunks(), table))

        def run(batches):
            words, vecs = given.value
            for b in batches:
                col = lambda n: b.column(b.schema.get_field_index(n))  # noqa: B023, E731
                toks, row = flat(col("toks"))
                n = col("ns").flatten().to_numpy(zero_copy_only=False)
                at = pc.index_in(toks, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
                there = at >= 0
                sums = np.stack([np.bincount(row[there], vecs[at[there], k] * n[there], minlength=b.num_rows) for k in range(size)], axis=1)
                others = [lists(x.filter(pa.array(~there)), row[~there], b.num_rows) for x in (toks, pa.array(n))]
                yield pa.RecordBatch.from_arrays([col("id"), pa.array(np.bincount(row, n, minlength=b.num_rows)), pa.array(list(sums), pa.list_(pa.float64())), *others], ["id", "n", "sums", "others", "ns"])

        rows = stored(held.mapInArrow(run, f"id {held.schema['id'].dataType.simpleString()}, n double, sums array<double>, others array<string>, ns array<bigint>"))
        rest = rows.where(F.size("others") > 0).select("id", F.explode(F.arrays_zip("others", "ns")).alias("t")).select("id", F.col("t.others").alias("tok"), F.col("t.ns").alias("n"))
        # the texts of a rare token come together once, for its count and its numbers
        by = rest.groupBy("tok").agg(F.collect_list(F.struct("id", "n")).alias("all"), F.sum("n").alias("n"))
        by = by.select((self.weight(F.col("n"), total) * 1.0).alias("weight"), numbers.alias("v"), F.explode("all").alias("r")).select("r.id", (F.col("r.n") * F.col("weight")).alias("x"), "v")
        more = by.groupBy("id").agg(*(F.sum((F.col("v")[k].cast("double") / SCALE * 2 - 1) * F.col("x")).alias(f"s{k}") for k in range(size)))
        vec = F.array(*((F.col("sums")[k] + F.coalesce(F.col(f"s{k}"), F.lit(0.0))) / F.col("n") for k in range(size)))
        return settled(rows.select("id", "n", "sums").join(more, "id", "left").select("id", F.when(F.col("n") > 0, vec).alias("vec")))

    def finished(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        return rows.withColumn("vec", F.coalesce("vec", hash_vector(F.col("id.id"), self.dimension(known))))

    def dimension(self, known: DataFrame) -> int:
        first = known.select(F.size("vec").alias("n")).first() if self.word_vectors is not None else None
        return first.n if first else self.size


def gram(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of outer products, sum, and number of (vec) rows, added up over partitions."""
    def run(batches):
        total, sums, n = None, None, 0
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
                sums = x.sum(0) if sums is None else sums + x.sum(0)
                n += len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([sums.tolist()]), pa.array([n])], ["g", "s", "n"])

    rows = vectors.where("vec is not null").select("vec").mapInArrow(run, "g array<double>, s array<double>, n long").collect()
    if not rows:
        return np.zeros((0, 0)), np.zeros(0), 0
    s = sum(np.array(r.s) for r in rows)
    return sum(np.array(r.g) for r in rows).reshape(len(s), len(s)), s, sum(r.n for r in rows)


def _literal(x: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def without_first_component(rows: DataFrame) -> DataFrame:
    """Each vec less its projection on the first right-singular vector of all of them."""
    g, _, n = gram(rows)
    if not n:
        return rows
    pc = np.linalg.eigh(g)[1][:, -1]
    return rows.withColumn("vec", F.zip_with("vec", F.transform(_literal(pc), lambda p: p * _dot(F.col("vec"), _literal(pc))), lambda x, y: x - y))


def reduced(rows: DataFrame, size: int, fit_share: float = 1.0, seed: int = 42) -> DataFrame:
    """vec on the first principal axes, fitted on a share of the rows and applied without centring."""
    g, s, n = gram(rows.sample(fit_share, seed) if fit_share < 1 else rows)
    if n < 2 or size >= len(s):
        return rows
    axes = np.linalg.eigh(g / n - np.outer(s / n, s / n))[1][:, ::-1][:, :size]
    return rows.withColumn("vec", F.array(*(_dot(F.col("vec"), _literal(axes[:, i])) for i in range(size))))


class SifEncoder(AverageEncoder):
    """Averages with tokens weighted a / (a + share), less the first component; principal axes stand in for manifold reduction."""

    def __init__(self, word_vectors: DataFrame | None = None, a: float = 1e-3, remove_pc: bool = True, min_freq: int = 0, reduce_to: int | None = None, tokenizer: Tokenizer | None = None, size: int = 16):
        super().__init__(word_vectors, tokenizer, size)
        self.a, self.remove_pc, self.min_freq, self.reduce_to = a, remove_pc, min_freq, reduce_to

    def weights(self, tokens: DataFrame) -> DataFrame:
        return sif_weights(tokens, self.a, self.min_freq)

    def weight(self, n: Column, total: int) -> Column:
        return F.when(n >= self.min_freq, F.lit(self.a) / (F.lit(self.a) + n / F.lit(float(max(1, total))))).otherwise(1.0)

    def finished(self, rows, known):
        rows = super().finished(rows, known)
        if self.remove_pc:
            rows = without_first_component(rows)
        return reduced(rows, self.reduce_to) if self.reduce_to else rows


def sif_weights(tokens: DataFrame, a: float = 1e-3, min_freq: int = 0) -> DataFrame:
    """(tok, n, weight) over all occurrences."""
    counts = tokens.groupBy("tok").agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    w = F.lit(a) / (F.lit(a) + F.col("n") / F.col("total"))
    return counts.crossJoin(total).select("tok", "n", F.when(F.col("n") >= min_freq, w).otherwise(1.0).alias("weight"))


class FunctionEncoder(Encoder):
    """A pre-trained sentence or transformer model, as a function of a list of texts to vectors that executors run in batches; then principal axes if wanted."""

    def __init__(self, function: Callable[[list[str]], Iterable], batch_size: int = 512, max_words: int | None = None, reduce_to: int | None = None, fit_share: float = 0.3):
        self.function, self.batch, self.max_words, self.reduce_to, self.fit_share = function, batch_size, max_words, reduce_to, fit_share

    def vectors(self, texts):
        function, size, words = self.function, self.batch, self.max_words

        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, size):
                    part = b.slice(i, size)
                    said = part.column(2).to_pylist()
                    vecs = function([" ".join(t.split()[:words]) for t in said] if words else said)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([[float(x) for x in v] for v in vecs], pa.list_(pa.float64()))], ["side", "id", "vec"])

        rows = texts.select("side", "id", "text").mapInArrow(run, "side int, id string, vec array<double>")
        return reduced(rows, self.reduce_to, self.fit_share) if self.reduce_to else rows


# graphs


def all_entities(texts: DataFrame, rel: DataFrame) -> DataFrame:
    return texts.select("id").unionAll(rel.select(F.col("head").alias("id"))).unionAll(rel.select("tail")).where("id is not null").distinct()


def filled(vectors: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, vec) of all ids; those without one get a vector from the id. Known ids must be among all."""
    return ids.join(vectors, "id", "left").select("id", F.coalesce("vec", hash_vector(F.col("id"), size)).alias("vec"))


def weighted_sums(edges: DataFrame, vectors: DataFrame, how: str = "sum") -> DataFrame:
    """(id, vec): for each src the sum (mean, min, max) of weight times vec over its dst; edges (src, dst, weight)."""
    x = F.col("x") * F.col("weight")
    agg = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how](x)
    # dimensions stay together in the join and part only in the aggregation
    rows = edges.join(vectors.withColumnRenamed("id", "dst"), "dst").select("src", "weight", F.posexplode("vec").alias("pos", "x"))
    parts = rows.groupBy("src", "pos").agg(agg.alias("x"))
    return parts.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))


def unit(vec: Column) -> Column:
    n = F.sqrt(_dot(vec, vec))
    return F.transform(vec, lambda x: x / F.greatest(n, F.lit(1e-12)))


class RelationEncoder(Encoder):
    """Attribute vectors, filled for entities that only relations name, then spread over the graph."""

    def __init__(self, attribute_encoder: Encoder | None = None, size: int = 16):
        self.attributes, self.size = attribute_encoder or SifEncoder(size=size), size

    def encode(self, left, right, left_rel=None, right_rel=None):
        from ..model import triples

        if left_rel is None or right_rel is None:
            raise ValueError("relation triples of both sides are needed")
        tag = lambda side, c: F.concat(F.lit(f"{side}:"), F.col(c))
        texts, rels = check_texts(left, right), (triples(left_rel), triples(right_rel))
        vecs = self.attributes.encode(*texts)
        known, rel, ids = None, None, None
        for k in (0, 1):
            v = vecs[k].select(tag(k, "name").alias("id"), "vec")
            r = rels[k].select(tag(k, "head").alias("head"), "relation", tag(k, "tail").alias("tail"))
            i = all_entities(texts[k], rels[k]).select(tag(k, "id").alias("id"))
            known, rel, ids = (v, r, i) if known is None else (known.unionByName(v), rel.unionByName(r), ids.unionByName(i))
        first = known.select(F.size("vec").alias("n")).first()
        out = self.spread(filled(known, ids, first.n if first else self.size), rel)
        side = lambda k: out.where(F.col("id").startswith(f"{k}:")).select(F.substring(F.col("id"), F.lit(3), F.length("id")).alias("name"), "vec")
        return side(0), side(1)

    def spread(self, vectors: DataFrame, rel: DataFrame) -> DataFrame:
        raise NotImplementedError


def adjacency(rel: DataFrame) -> DataFrame:
    """(src, dst, weight): distinct triples of an ordered pair either way, and on the diagonal those at an entity, unless it has loops to count."""
    t = rel.select("head", "relation", "tail").distinct()
    both = t.select(F.col("head").alias("src"), F.col("tail").alias("dst"), F.concat(F.lit("+"), "relation").alias("r")).unionByName(t.select(F.col("tail").alias("src"), F.col("head").alias("dst"), F.concat(F.lit("-"), "relation").alias("r")))
    off = both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    at = t.select(F.col("head").alias("src")).unionAll(t.select(F.col("tail").alias("src"))).groupBy("src").agg(F.count("*").cast("double").alias("n"))
    loops = off.where("src = dst").select("src", F.col("weight").alias("own"))
    diagonal = at.join(loops, "src", "left").select("src", F.col("src").alias("dst"), F.coalesce("own", "n").alias("weight"))
    return off.where("src != dst").unionByName(diagonal)


class LightEAEncoder(RelationEncoder):
    """``depth`` rounds of relations taking the sum of their heads and entities that of neighbours and relations, each to unit length; the rounds are put side by side."""

    def __init__(self, attribute_encoder=None, depth: int = 2, only_neighbors: bool = False, size: int = 16):
        super().__init__(attribute_encoder, size)
        self.depth, self.only_neighbors = depth, only_neighbors

    def spread(self, vectors, rel):
        t = rel.select("head", "relation", "tail").distinct()
        links = t.select(F.col("head").alias("e"), F.concat(F.lit("+"), "relation").alias("r")).unionByName(t.select(F.col("tail").alias("e"), F.concat(F.lit("-"), "relation").alias("r")))
        links = links.groupBy("e", "r").agg(F.count("*").cast("double").alias("weight"))
        near = adjacency(rel)
        e = settled(vectors.select("id", unit(F.col("vec")).alias("vec")))
        rounds = [] if self.only_neighbors else [e]
        r = None
        for _ in range(self.depth):
            own = weighted_sums(links.select(F.col("r").alias("src"), F.col("e").alias("dst"), "weight"), e).select("id", unit(F.col("vec")).alias("vec"))
            parts = near.unionByName(links.select(F.col("e").alias("src"), F.col("r").alias("dst"), "weight")) if r is not None else near
            source = e.unionByName(r) if r is not None else e
            new = weighted_sums(parts, source).select("id", unit(F.col("vec")).alias("vec"))
            e = settled(e.withColumnRenamed("vec", "old").join(new, "id", "left").select("id", F.coalesce("vec", "old").alias("vec")))
            r = settled(own)
            rounds.append(e)
        out = rounds[0].withColumnRenamed("vec", "v0")
        for k, x in enumerate(rounds[1:], 1):
            out = out.join(x.withColumnRenamed("vec", f"v{k}"), "id")
        return out.select("id", unit(F.concat(*(F.col(f"v{k}") for k in range(len(rounds))))).alias("vec"))


def normalised_edges(rel: DataFrame, ids: DataFrame, edge_weight: float = 1.0, self_weight: float = 2.0) -> DataFrame:
    """(src, dst, weight): head to tail and a loop at each entity, divided by the roots of both ends' degrees, which are counted at tails."""
    e = rel.select(F.col("head").alias("src"), F.col("tail").alias("dst"), F.lit(float(edge_weight)).alias("w")).where("src != dst")
    e = e.unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(float(self_weight)).alias("w")))
    degree = e.groupBy("dst").agg(F.sum("w").alias("d"))
    a, b = degree.select(F.col("dst").alias("src"), F.col("d").alias("ds")), degree.select("dst", F.col("d").alias("dd"))
    return e.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("weight"))


class GcnEncoder(RelationEncoder):
    """``depth`` hops of normalised sums of tails into heads, with a fixed random linear layer each if ``layers``."""

    def __init__(self, attribute_encoder=None, depth: int = 2, edge_weight: float = 1.0, self_weight: float = 2.0, layer_dims: int = 16, bias: bool = False, layers: bool = True, aggr: str = "sum", seed: int = 17, size: int = 16):
        super().__init__(attribute_encoder, size)
        self.depth, self.edge_weight, self.self_weight, self.dims, self.bias, self.layers, self.aggr, self.seed = depth, edge_weight, self_weight, layer_dims, bias, layers, aggr, seed

    def spread(self, vectors, rel):
        edges = normalised_edges(rel, vectors.select("id"), self.edge_weight, self.self_weight)
        r = np.random.RandomState(self.seed)
        first = vectors.select(F.size("vec").alias("n")).first()
        n = first.n if first else self.size
        x = vectors
        for _ in range(self.depth):
            x = settled(weighted_sums(edges, x, self.aggr))
            if self.layers:
                bound = np.sqrt(6 / (n + self.dims))
                w = r.uniform(-bound, bound, (n, self.dims))
                b = r.uniform(-bound, bound, self.dims) if self.bias else np.zeros(self.dims)
                x = x.select("id", F.array(*(_dot(F.col("vec"), _literal(w[:, i])) + F.lit(float(b[i])) for i in range(self.dims))).alias("vec"))
                n = self.dims
        return x


# trained on the texts


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float = 1e-3):
        self.p, self.rate, self.t = parameters, rate, 0
        self.m, self.v = ([np.zeros_like(p) for p in parameters] for _ in range(2))

    def step(self, grads: list[np.ndarray]):
        self.t += 1
        for p, g, m, v in zip(self.p, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class Layers:
    """Linear layers with rectifiers between them."""

    def __init__(self, sizes: list[int], r: np.random.RandomState):
        self.w = [r.uniform(-1, 1, (a, b)) / np.sqrt(a) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def parameters(self):
        return [*self.w, *self.b]

    def forward(self, x):
        kept = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            x = x @ w + b
            if i < len(self.w) - 1:
                x = np.maximum(x, 0)
            kept.append(x)
        return x, kept

    def step_back(self, d, kept):
        gw, gb = [], []
        for i in range(len(self.w) - 1, -1, -1):
            gw.insert(0, kept[i].T @ d)
            gb.insert(0, d.sum(0))
            d = d @ self.w[i].T
            if i:
                d = d * (kept[i] > 0)
        return [*gw, *gb], d


class TrainedEncoder(Encoder):
    """A base encoder's vectors through a network trained on a bounded sample of them on the driver; executors apply it to all."""

    def __init__(self, base: Encoder | None = None, hidden: tuple[int, int] = (32, 16), epochs: int = 50, batch_size: int = 256, rate: float = 1e-3, sample: int = 10_000, seed: int = 17):
        self.base = base or SifEncoder()
        self.hidden, self.epochs, self.batch, self.rate, self.sample, self.seed = hidden, epochs, batch_size, rate, sample, seed

    def vectors(self, texts):
        rows = self.base.vectors(texts)
        net = self.fit(texts, rows)
        return self.applied(rows, net)

    def sampled(self, rows: DataFrame) -> list:
        return rows.orderBy(F.xxhash64("side", "id"), "side", "id").limit(self.sample).collect()

    def applied(self, rows: DataFrame, net: Layers) -> DataFrame:
        given = rows.sparkSession.sparkContext.broadcast(net)

        def run(batches):
            for b in batches:
                x = np.array(b.column(2).to_pylist(), float)
                y = given.value.forward(x)[0] if len(x) else x
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(y.tolist(), pa.list_(pa.float64()))], ["side", "id", "vec"])

        return rows.select("side", "id", "vec").mapInArrow(run, "side int, id string, vec array<double>")

    def fit(self, texts: DataFrame, rows: DataFrame) -> Layers:
        raise NotImplementedError


class AutoencoderEncoder(TrainedEncoder):
    """The inner layer of an autoencoder."""

    def fit(self, texts, rows):
        r = np.random.RandomState(self.seed)
        x = np.array([v.vec for v in self.sampled(rows)], float)
        n = x.shape[1] if x.size else 1
        down, up = Layers([n, *self.hidden], r), Layers([*self.hidden[::-1], n], r)
        adam = Adam(down.parameters() + up.parameters(), self.rate)
        for _ in range(self.epochs if len(x) else 0):
            order = r.permutation(len(x))
            for i in range(0, len(x), self.batch):
                part = x[order[i : i + self.batch]]
                h, kept = down.forward(part)
                y, kept2 = up.forward(h)
                g2, d = up.step_back(2 * (y - part) / part.size, kept2)
                g1, _ = down.step_back(d, kept)
                adam.step(g1 + g2)
        return down


class CrossTupleEncoder(TrainedEncoder):
    """A siamese network that tells texts with words left out from other texts."""

    def __init__(self, *args, per_text: int = 5, negatives: float = 1.0, most_dropped: float = 0.4, **kw):
        super().__init__(*args, **kw)
        self.per_text, self.negatives, self.most_dropped = per_text, negatives, most_dropped

    def pairs(self, texts: DataFrame) -> DataFrame:
        """(side, id, text, pair, role, label) of synthetic pairs: role 0 is the text, 1 its partner."""
        base = texts.orderBy(F.xxhash64("side", "id"), "side", "id").limit(max(2, self.sample // (2 * self.per_text)))
        words = F.split("text", " ")
        rows = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(self.per_text - 1))))
        share = F.pmod(F.xxhash64("id", "k"), F.lit(1000)) / 1000 * self.most_dropped
        dropped = F.array_join(F.filter(words, lambda w, i: F.pmod(F.xxhash64(w, i, "id", "k"), F.lit(1000)) / 1000 >= share), " ")
        pos = rows.select("side", "id", "k", "text", dropped.alias("other"), F.lit(1.0).alias("label"))
        few = base.select(F.col("text").alias("other"), (F.row_number().over(_window()) - 1).alias("n"))
        total = few.count()
        neg = rows.where(F.col("k") < int(round(self.per_text * self.negatives))).withColumn("n", F.pmod(F.xxhash64("side", "id", "k"), F.lit(max(1, total))).cast("int"))
        neg = neg.join(few, "n").where("text != other").select("side", "id", "k", "text", "other", F.lit(0.0).alias("label"))
        return pos.unionByName(neg)

    def fit(self, texts, rows):
        r = np.random.RandomState(self.seed)
        p = self.pairs(texts).withColumn("pair", F.concat_ws(":", "side", "id", "k", "label"))
        both = p.select(F.lit(0).alias("side"), F.col("pair").alias("id"), "text").unionByName(p.select(F.lit(1).alias("side"), F.col("pair").alias("id"), F.col("other").alias("text")))
        v = self.base.vectors(both)
        a, b = v.where("side = 0").select("id", F.col("vec").alias("a")), v.where("side = 1").select("id", F.col("vec").alias("b"))
        got = a.join(b, "id").orderBy("id").collect()
        x, y = (np.array([g[c] for g in got], float) for c in ("a", "b"))
        label = np.array([float(g.id.rsplit(":", 1)[1]) for g in got])
        n = x.shape[1] if x.size else 1
        net, w, c = Layers([n, *self.hidden], r), r.uniform(-1, 1, self.hidden[-1]) / np.sqrt(self.hidden[-1]), np.zeros(1)
        adam = Adam([*net.parameters(), w, c], self.rate)
        for _ in range(self.epochs if len(got) else 0):
            order = r.permutation(len(got))
            for i in range(0, len(got), self.batch):
                k = order[i : i + self.batch]
                (h1, k1), (h2, k2) = net.forward(x[k]), net.forward(y[k])
                diff = np.abs(h1 - h2)
                d = (1 / (1 + np.exp(-(diff @ w + c))) - label[k]) / len(k)
                dd = d[:, None] * w * np.sign(h1 - h2)
                g1, g2 = net.step_back(dd, k1)[0], net.step_back(-dd, k2)[0]
                adam.step([*(s + t for s, t in zip(g1, g2, strict=True)), diff.T @ d, np.array([d.sum()])])
        return net


def _window():
    from pyspark.sql import Window

    return Window.orderBy(F.xxhash64("side", "id"), "side", "id")


class HybridEncoder(CrossTupleEncoder):
    """Cross-tuple training on top of an autoencoder's vectors."""

    def __init__(self, base: Encoder | None = None, **kw):
        super().__init__(AutoencoderEncoder(base, **{k: v for k, v in kw.items() if k in ("hidden", "epochs", "seed", "sample")}), **kw)


TRAINED = (TrainedEncoder,)
ENCODERS = {"average": AverageEncoder, "sif": SifEncoder, "light_ea": LightEAEncoder, "gcn": GcnEncoder, "autoencoder": AutoencoderEncoder, "cross_tuple": CrossTupleEncoder, "hybrid": HybridEncoder}


def encoder(name: str | Encoder | None = None, **options) -> Encoder:
    if isinstance(name, Encoder):
        return name
    return ENCODERS[name or "sif"](**options)


__all__ = [n for n in dir() if n.endswith("Encoder")] + ["encoder", "mean_vectors"]

"""Exact nearest neighbours in blocks, hubness reduction, sparse Sinkhorn, and block builders."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..blocks import BlockSet, NNBlockSet
from ..functions.lineage import settled
from .hdbscan import across, between, forest, grown, hdbscan, labelled, reach, tree

PACK = 2048
#: Bytes of the vectors in a group of the right side, and of a matrix of distances.
RIGHT_BYTES, MATRIX = 16 << 20, 1 << 22
BATCH_BYTES = 64 << 20
METRICS = ("euclidean", "sqeuclidean", "cosine")


def _packed(df: DataFrame, prefix: str, size: int) -> DataFrame:
    """Rows (name, vec) of a settled table gathered in groups of about ``size``, which lie apart: small in bytes, they would be one task."""
    groups = max(1, math.ceil(df.count() / size))
    packs = df.groupBy(F.pmod(F.xxhash64("name"), F.lit(groups)).alias(f"{prefix}_pack")).agg(F.collect_list("name").alias(f"{prefix}_names"), F.flatten(F.collect_list("vec")).alias(f"{prefix}_vecs"))
    return packs.repartition(min(groups, 24))


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return 1 - unit(a) @ unit(b).T
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))  # differences of a block take 32 MB at most, or one row's
    for i in range(0, len(a), step):
        d = a[i : i + step, None] - b[None]
        out[i : i + step] = np.einsum("ijk,ijk->ij", d, d)
    return out if metric == "sqeuclidean" else np.sqrt(out)


def closest(a: np.ndarray, b: np.ndarray, k: int, metric: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of a the rows of b among the k nearest, ties with the last of them too, and their distances to nine digits.

    A matrix product finds all that may be near enough, whatever it rounds; only
    their differences are taken.
    """
    step = max(1, MATRIX // max(1, len(b)))
    if len(a) > step:
        return [x for i in range(0, len(a), step) for x in closest(a[i : i + step], b, k, metric)]
    if metric == "cosine":
        d = np.round(distances(a, b, metric), 9)
    else:
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    out = []
    k = min(k, len(b))
    for i in range(len(a)):
        if metric == "cosine":
            near = np.flatnonzero(d[i] <= np.partition(d[i], k - 1)[k - 1])
            out.append((near, d[i, near]))
            continue
        slack = 1e-9 + 1e-12 * (square[i].max() + a.shape[1])
        last = max(0.0, np.partition(square[i], k - 1)[k - 1])
        # what rounds to the same nine digits as the last one is as near as it
        near = np.flatnonzero(square[i] <= (np.sqrt(last + slack) + 2e-9) ** 2 + slack)
        exact = np.round(distances(a[i : i + 1], b[near], metric)[0], 9)
        keep = exact <= np.partition(exact, k - 1)[k - 1]
        out.append((near[keep], exact[keep]))
    return out


def _vectors(column: pa.Array, i: int, rows: int) -> np.ndarray:
    """The i-th list of a column as rows of a matrix, without Python numbers."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[i] : ends[i + 1]].astype(float).reshape(rows, -1)


def _nearest(k: int, metric: str):
    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 1) for i in range(whole.num_rows)):
                col = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
                ln, alike = col("l_names").to_pylist()[0], col("r_names")[0].values
                # names of one vector lie side by side
                names, ends = np.array(alike.flatten().to_pylist()), np.r_[0, np.cumsum(alike.value_lengths().to_numpy())]
                left, right, dist = [], [], []
                found = closest(_vectors(col("l_vecs"), 0, len(ln)), _vectors(col("r_vecs"), 0, len(alike)), k, metric)
                for name, (near, d) in zip(ln, found, strict=True):
                    at = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in near])
                    d = np.repeat(d, ends[near + 1] - ends[near])
                    # the window below orders ties by name
                    order = np.lexsort((names[at], d))[:k]
                    left += [name] * len(order)
                    right += names[at][order].tolist()
                    dist += d[order].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(dist, pa.float64())], ["left_id", "right_id", "distance"])

    return run


def nearest(left: DataFrame, right: DataFrame, k: int, metric: str = "euclidean", pack: int = PACK) -> DataFrame:
    """(left_id, rank, right_id, distance) of (name, vec) frames: the k nearest right vectors of each left one, ties by name.

    Equal vectors meet once: those of the left side are searched for one of them, and
    of those of the right side the k least names are all that can be wanted. Groups of
    vectors meet, not rows; each meeting keeps k for each left vector, so what is
    shuffled is the distinct left vectors times k times the number of right groups.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    # a meeting of two groups is megabytes, so Arrow batches are bounded by bytes
    conf, key = left.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(key, f"{BATCH_BYTES}b")
    left = settled(left.select("name", "vec"))
    mine = settled(left.groupBy("vec").agg(F.min("name").alias("name")))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("name"))
    yours = settled(right.select("name", "vec", place.alias("place")).where(F.col("place") <= k).groupBy("vec").agg(F.sort_array(F.collect_list("name")).alias("name")))
    size = yours.agg(F.max(F.size("vec"))).first()[0] or 1
    both = _packed(mine, "l", pack).hint("shuffle_replicate_nl").crossJoin(settled(_packed(yours, "r", max(pack, RIGHT_BYTES // (8 * size)))))
    part = both.mapInArrow(_nearest(k, metric), "left_id string, right_id string, distance double")
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy("distance", "right_id"))
    best = part.withColumn("rank", rank - 1).where(F.col("rank") < k).withColumnRenamed("left_id", "first")
    members = left.join(mine.withColumnRenamed("name", "first"), "vec").select("first", F.col("name").alias("left_id"))
    return members.join(best, "first").select("left_id", "rank", "right_id", "distance")


HUBNESS = (None, "csls", "local_scaling", "nicdm", "mutual_proximity", "dis_sim")


def _normal_tail(x: Column, mean: Column, sd: Column) -> Column:
    """P(X > x), by the usual logistic approximation of the normal distribution."""
    z = (x - mean) / F.greatest(sd, F.lit(1e-12))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def reduced_hubness(left: DataFrame, right: DataFrame, candidates: int, method: str, metric: str = "euclidean") -> DataFrame:
    """(left_id, right_id, distance): candidates' distances corrected for hubs, from the neighbours of both sides."""
    if method not in HUBNESS:
        raise ValueError(f"hubness is one of {HUBNESS}")
    there = nearest(left, right, candidates, metric)
    back = nearest(right, left, candidates, metric)
    local = lambda d, n: d.groupBy(F.col("left_id").alias(n)).agg(F.avg("distance").alias(f"{n}_mean"), F.max("distance").alias(f"{n}_far"), F.stddev_pop("distance").alias(f"{n}_sd"))
    rows = there.join(local(there, "left_id"), "left_id").join(local(back, "right_id"), "right_id")
    d = F.col("distance")
    lm, rm, lf, rf, ls, rs = (F.col(f"{s}_id_{c}") for c in ("mean", "far", "sd") for s in ("left", "right"))
    if method == "csls":
        new = 2 * d - lm - rm
    elif method == "local_scaling":
        new = 1 - F.exp(-d * d / F.greatest(lf * rf, F.lit(1e-12)))
    elif method == "nicdm":
        new = d / F.sqrt(F.greatest(lm * rm, F.lit(1e-12)))
    elif method == "mutual_proximity":
        new = 1 - _normal_tail(d, lm, ls) * _normal_tail(d, rm, rs)
    else:
        return _dis_sim(left, right, there, back)
    return rows.select("left_id", "right_id", new.alias("distance"))


def _dis_sim(left, right, there, back):
    """Squared distance less the squared distances of both to the centroids of their neighbours."""
    def own(vectors, links, others, name):
        means = mean_vectors(links.join(others.withColumnRenamed("name", "right_id"), "right_id").select(F.col("left_id").alias("id"), "vec"))
        d2 = F.aggregate(F.zip_with("vec", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return vectors.join(means.select(F.col("id").alias("name"), F.col("vec").alias("mean")), "name").select(F.col("name").alias(name), d2.alias(f"{name}_own"))

    a, b = own(left, there, right, "left_id"), own(right, back, left, "right_id")
    return there.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", (F.col("distance") * F.col("distance") - F.col("left_id_own") - F.col("right_id_own")).alias("distance"))


def mean_vectors(rows: DataFrame) -> DataFrame:
    """(id, vec) rows to one mean vector an id."""
    parts = rows.select("id", F.posexplode("vec").alias("pos", "x")).groupBy("id", "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))


def sinkhorn(candidates: DataFrame, iterations: int = 10, reg: float = 0.05) -> DataFrame:
    """(left_id, right_id, weight) of (left_id, right_id, distance): row and column normalisation in turn on the sparse support."""
    ends = F.broadcast(candidates.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi")))
    # similarity is minus the distance, scaled to 0..1 over all
    sim = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("distance")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    w = candidates.crossJoin(ends).select("left_id", "right_id", F.exp(sim / reg).alias("weight"))
    for i in range(iterations):
        for side in ("left_id", "right_id"):
            w = w.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(side)))
        if i % 5 == 4:
            w = settled(w)
    return w


class BlockBuilder:
    def build(self, left: DataFrame, right: DataFrame, left_name: str = "left", right_name: str = "right"):
        raise NotImplementedError


class NearestNeighborBuilder(BlockBuilder):
    """The n nearest right vectors of each left one, of at least as many candidates, with hubness reduction if wanted."""

    def __init__(self, n_neighbors: int = 5, n_candidates: int = 10, metric: str = "euclidean", hubness: str | None = None):
        self.n, self.candidates, self.metric, self.hubness = n_neighbors, max(n_candidates, n_neighbors), metric, hubness

    def build(self, left, right, left_name="left", right_name="right") -> NNBlockSet:
        if self.hubness is None:
            return NNBlockSet(nearest(left, right, self.n, self.metric), left_name, right_name)
        found = reduced_hubness(left, right, self.candidates, self.hubness, self.metric)
        return NNBlockSet(_ranked(found, F.asc("distance"), self.n), left_name, right_name)


def _ranked(rows: DataFrame, order: Column, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(order, "right_id"))
    return rows.withColumn("rank", rank - 1).where(F.col("rank") < n)


class SinkhornBuilder(BlockBuilder):
    """Candidates re-ranked by sparse Sinkhorn weights."""

    def __init__(self, n_neighbors: int = 5, n_candidates: int = 10, iterations: int = 10, reg: float = 0.05, metric: str = "euclidean"):
        self.n, self.candidates, self.iterations, self.reg, self.metric = n_neighbors, max(n_candidates, n_neighbors), iterations, reg, metric

    def build(self, left, right, left_name="left", right_name="right") -> NNBlockSet:
        w = sinkhorn(nearest(left, right, self.candidates, self.metric).select("left_id", "right_id", "distance"), self.iterations, self.reg)
        return NNBlockSet(_ranked(w.withColumn("weight", F.round("weight", 9)), F.desc("weight"), self.n), left_name, right_name)


def cluster_blocks(left: DataFrame, right: DataFrame, left_name: str = "left", right_name: str = "right") -> BlockSet:
    """(id, label) frames to a block for each label; noise (-1) is a label like others."""
    side = lambda d: d.select(F.col("label").cast("string").alias("block_id"), F.col("id").alias("entity_id"))
    return BlockSet(side(left), side(right), left_name, right_name)


#: Vectors of a group in density clustering; so many are clustered on the driver at once.
GROUP, GROUP_BYTES = 2048, 8 << 20
#: Groups a side of what one forest joins before the driver has it.
JOINED = 4


def _numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows of a sorted table with their place ``i``, and how many there are."""
    rows = settled(rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    first, total = {}, 0
    for k, n in sizes:
        first[k], total = total, total + n
    starts = rows.sparkSession.createDataFrame(list(first.items()) or [(0, 0)], "part long, start long")
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").select("side", "name", "vec", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("i")), total


def _cell(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name))[i].values.to_numpy(zero_copy_only=False)


def _sorted(i: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(i)
    return [i[order], *(x[order] for x in others)]


def _least(k: int, metric: str):
    """Of two groups that meet, the k least distances of each row of the first."""
    def run(batches):
        for whole in batches:
            for j in range(whole.num_rows):
                cell = lambda n: _cell(whole, n, j)  # noqa: B023, E731
                mine, yours = cell("li"), cell("ri")
                d = between(cell("lv").reshape(len(mine), -1), cell("rv").reshape(len(yours), -1), metric)
                group = whole.column(whole.schema.get_field_index("l"))[j].as_py()
                if group == whole.column(whole.schema.get_field_index("r"))[j].as_py():
                    d[mine[:, None] == yours[None]] = 0
                most = min(k, len(yours))
                near = np.full((len(mine), k), np.inf)
                near[:, :most] = np.partition(d, most - 1, axis=1)[:, :most]
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([mine]), pa.array([near.ravel()])], ["g", "i", "near"])

    return run


def _cores(k: int):
    def run(table: pa.Table) -> pa.Table:
        groups = [_sorted(_cell(b, "i", j), _cell(b, "near", j).reshape(-1, k)) for b in table.to_batches() for j in range(b.num_rows)]
        core = np.partition(np.concatenate([n for _, n in groups], axis=1), k - 1, axis=1)[:, k - 1]
        return pa.table({"g": pa.array([table["g"][0].as_py()], pa.int64()), "ci": pa.array([groups[0][0]]), "core": pa.array([core])})

    return run


def _own_trees(metric: str, alpha: float):
    """Each group in the order of its rows, with the edges (a, b, w) of its least spanning tree by their places."""
    def run(batches):
        for whole in batches:
            for j in range(whole.num_rows):
                i = _cell(whole, "i", j)
                i, v = _sorted(i, _cell(whole, "v", j).reshape(len(i), -1))
                core = _sorted(_cell(whole, "ci", j), _cell(whole, "core", j))[1]
                edges = tree(reach(between(v, v, metric), core, alpha)) if len(i) > 1 else np.zeros((0, 3))
                group = whole.column(whole.schema.get_field_index("g"))[j].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), *(pa.array([x]) for x in (i, v.ravel(), core, *edges.T.copy()))], ["g", "i", "v", "core", "a", "b", "w"])

    return run


def _trees(metric: str, alpha: float):
    """Of two groups that meet, the least spanning tree of both."""
    def run(batches):
        for whole in batches:
            for j in range(whole.num_rows):
                one = lambda n: whole.column(whole.schema.get_field_index(n))[j].as_py()  # noqa: B023, E731

                def side(s):
                    i, v, core = (_cell(whole, f"{s}{c}", j) for c in ("i", "v", "core"))  # noqa: B023
                    return i, v.reshape(len(i), -1), core, np.stack([_cell(whole, f"{s}{c}", j) for c in "abw"], axis=1)  # noqa: B023

                i, v, core, edges = side("l")
                if one("l") != one("r"):
                    k, y, other, more = side("r")
                    d = between(v, y, metric)
                    d /= alpha
                    np.maximum(d, core[:, None], out=d)
                    edges = across(np.maximum(d, other[None], out=d), edges, more)
                    i = np.concatenate([i, k])
                a, b = (i[edges[:, c].astype(int)] for c in (0, 1))
                key = np.full(len(edges), (one("l") // JOINED << 31) + one("r") // JOINED)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(edges[:, 2])], ["key", "a", "b", "w"])

    return run


def _joined(table: pa.Table) -> pa.Table:
    kept = forest(_edges(table))
    return pa.table({"a": kept[:, 0].astype(np.int64), "b": kept[:, 1].astype(np.int64), "w": kept[:, 2]})


def _edges(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy().astype(float) for c in ("a", "b", "w")], axis=1)


def spanning_tree(rows: DataFrame, n: int, min_samples: int, metric: str, alpha: float) -> np.ndarray:
    """Ascending edges (a, b, weight) of a least spanning tree of mutual reachability over n rows (i, vec).

    Groups of vectors meet in pairs. Every edge lies within a pair of groups, whose
    tree joins its ends by edges as short, so the trees of all pairs hold one of the
    whole; a group's own tree is found once, and a pair adds what lies between the two; the driver has no vectors and, of some pairs together, one forest.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    k = min(min_samples, n)
    size = max(1, min(GROUP, GROUP_BYTES // (8 * max(1, rows.select(F.size("vec")).first()[0]))))
    tasks = max(1, min(24, math.ceil(n / size)))
    group = F.floor(F.col("i") / size).cast("long").alias("g")
    packs = rows.groupBy(group).agg(F.collect_list("i").alias("i"), F.flatten(F.collect_list("vec")).alias("v"))
    packs = settled(packs.repartition(tasks, "g"))
    named = lambda d, s, cols: d.select(F.col("g").alias(s), *(F.col(c).alias(f"{s}{c}") for c in cols))
    # groups meet as partitions do, without a shuffle of the pairs
    meet = named(packs, "l", "iv").hint("shuffle_replicate_nl").crossJoin(named(packs, "r", "iv"))
    cores = meet.mapInArrow(_least(k, metric), "g long, i array<long>, near array<double>").groupBy("g").applyInArrow(_cores(k), "g long, ci array<long>, core array<double>")
    own = packs.join(cores, "g").mapInArrow(_own_trees(metric, alpha), "g long, i array<long>, v array<double>, core array<double>, a array<double>, b array<double>, w array<double>")
    full = settled(own.repartition(tasks, "g"))
    cols = ("i", "v", "core", "a", "b", "w")
    pairs = named(full, "l", cols).hint("shuffle_replicate_nl").join(named(full, "r", cols), F.col("l") <= F.col("r"))
    trees = pairs.mapInArrow(_trees(metric, alpha), "key long, a long, b long, w double")
    found = trees.groupBy("key").applyInArrow(_joined, "a long, b long, w double").toArrow()
    return grown(forest(_edges(found)), n)


def clustered(left: DataFrame, right: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(id, label) of both sides, clustered together; beyond GROUP rows the distances are taken by the executors."""
    spark = left.sparkSession
    rows = left.select(F.lit(0).alias("side"), "name", "vec").unionByName(right.select(F.lit(1).alias("side"), "name", "vec")).orderBy("side", "name")
    rows, n = _numbered(rows)
    if n <= GROUP:
        few = rows.select("i", "vec").orderBy("i").collect()
        labels = hdbscan(np.array([r.vec for r in few], float).reshape(n, -1), **options) if n else np.zeros(0, int)
    else:
        o = {"min_cluster_size": 5, "min_samples": None, "metric": "euclidean", "alpha": 1.0} | options
        edges = spanning_tree(rows, n, o["min_samples"] or o["min_cluster_size"], o.pop("metric"), o.pop("alpha"))
        o.pop("min_samples")
        labels = labelled(n, edges, **o)
    found = spark.createDataFrame(pa.table({"i": np.arange(n), "label": np.asarray(labels, np.int32)}))
    both = settled(rows.select("side", "i", F.col("name").alias("id")).join(found, "i"))
    side = lambda k: both.where(F.col("side") == k).select("id", "label")
    return side(0), side(1)


class HdbscanBuilder(BlockBuilder):
    def __init__(self, min_cluster_size: int = 5, min_samples: int | None = None, cluster_selection_epsilon: float = 0.0, metric: str = "euclidean", alpha: float = 1.0, cluster_selection_method: str = "eom"):
        self.options = {"min_cluster_size": min_cluster_size, "min_samples": min_samples, "epsilon": cluster_selection_epsilon, "metric": metric, "alpha": alpha, "method": cluster_selection_method}

    def build(self, left, right, left_name="left", right_name="right") -> BlockSet:
        return cluster_blocks(*clustered(left, right, **self.options), left_name, right_name)


def approximate_pairs(left: DataFrame, right: DataFrame, size: int, tables: int = 16, bits: int = 8, seed: int = 5) -> DataFrame:
    """(left_id, right_id): names whose vectors lie on the same side of all ``bits`` random hyperplanes of one of ``tables`` sets."""
    r = np.random.RandomState(seed)
    planes = r.randn(tables, bits, size)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        dot = lambda p: F.aggregate(F.zip_with("vec", F.array(*(F.lit(float(x)) for x in p)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        keys = [F.concat(F.lit(f"{t}:"), *(F.when(dot(p) >= 0, "1").otherwise("0") for p in planes[t])) for t in range(tables)]
        return df.select(F.col("name").alias(name), F.explode(F.array(*keys)).alias("key"))

    return keyed(left, "left_id").join(keyed(right, "right_id"), "key").select("left_id", "right_id").distinct()


class ApproximateBuilder(BlockBuilder):
    """Nearest neighbours among the vectors that share a hash of random hyperplanes; distances are exact, neighbours may be missed."""

    def __init__(self, n_neighbors: int = 5, tables: int = 16, bits: int = 8, seed: int = 5):
        self.n, self.tables, self.bits, self.seed = n_neighbors, tables, bits, seed

    def build(self, left, right, left_name="left", right_name="right") -> NNBlockSet:
        first = left.select(F.size("vec").alias("n")).first()
        pairs = approximate_pairs(left, right, first.n if first else 1, self.tables, self.bits, self.seed)
        a, b = left.select(F.col("name").alias("left_id"), F.col("vec").alias("a")), right.select(F.col("name").alias("right_id"), F.col("vec").alias("b"))
        d = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        rows = pairs.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", F.round(d, 9).alias("distance"))
        return NNBlockSet(_ranked(rows, F.asc("distance"), self.n), left_name, right_name)


BUILDERS = {"nearest": NearestNeighborBuilder, "approximate": ApproximateBuilder, "sinkhorn": SinkhornBuilder, "hdbscan": HdbscanBuilder}


def builder(name: str | BlockBuilder | None = None, **options) -> BlockBuilder:
    if isinstance(name, BlockBuilder):
        return name
    return BUILDERS[name or "nearest"](**options)

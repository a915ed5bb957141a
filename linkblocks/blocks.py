"""Blocks: memberships of entities of two sides, their pairs, sizes, combination and purging."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.lineage import bounded, settled

BIG = "bigint"


class BlockSet:
    """Distinct memberships (block_id, entity_id) of each side.

    Only blocks with members on both sides count, unless ``one_sided``. Nothing is
    gathered into arrays before ``wide``; sizes and pairs come from the long form.
    """

    def __init__(self, left: DataFrame, right: DataFrame, left_name: str = "left", right_name: str = "right", one_sided: bool = False, distinct: bool = True):
        shape = lambda d: d.select(F.col("block_id").cast("string").alias("block_id"), F.col("entity_id").cast("string").alias("entity_id"))
        left, right = shape(left), shape(right)
        self.left = left.distinct() if distinct else left
        self.right = right.distinct() if distinct else right
        self.left_name, self.right_name, self.one_sided = left_name, right_name, one_sided
        self._sizes: DataFrame | None = None

    @property
    def columns(self) -> list[str]:
        return [self.left_name, self.right_name]

    def settle(self) -> BlockSet:
        """Memberships that later plans read, not compute again."""
        self.left, self.right = settled(self.left), settled(self.right)
        return self

    # sizes

    def sizes(self) -> DataFrame:
        """(block_id, n_left, n_right), by one shuffle of partial counts; where they were settled, as they were."""
        if self._sizes is not None:
            return self._sizes
        one = lambda d, a, b: d.select("block_id", F.lit(a).alias("l"), F.lit(b).alias("r"))
        out = one(self.left, 1, 0).unionAll(one(self.right, 0, 1)).groupBy("block_id").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
        return out if self.one_sided else out.where("n_left > 0 and n_right > 0")

    def __len__(self) -> int:
        return self.sizes().count()

    def assignments(self) -> DataFrame:
        """(block_id, assignments): members of both sides."""
        return self.sizes().select("block_id", (F.col("n_left") + F.col("n_right")).alias("assignments"))

    def comparisons(self) -> DataFrame:
        return self.sizes().select("block_id", (F.col("n_left") * F.col("n_right")).alias("comparisons"))

    block_sizes = assignments

    def distinct_comparisons(self) -> DataFrame:
        """One row (comparisons): pairs, each once."""
        return self.all_pairs().distinct().agg(F.count("*").alias("comparisons"))

    def mean_block_size(self) -> float | None:
        return self.assignments().agg(F.avg("assignments")).first()[0]

    def statistics(self, left_length: int | Column | None = None, right_length: int | Column | None = None) -> DataFrame:
        """One row: blocks, pairs with duplicates, assignments, mean size, comparisons cardinality and, given lengths, blocking cardinalities."""
        total = F.sum(F.col("n_left") + F.col("n_right"))
        pairs = F.coalesce(F.sum(F.col("n_left") * F.col("n_right")), F.lit(0)).cast(BIG)
        cols = [
            F.count("*").alias("blocks"), pairs.alias("pairs"), F.coalesce(total, F.lit(0)).cast(BIG).alias("assignments"),
            F.avg(F.col("n_left") + F.col("n_right")).alias("mean_block_size"),
            (total / F.sum(F.col("n_left") * F.col("n_right"))).alias("comparisons_cardinality"),
        ]
        if left_length is not None:
            as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
            nl, nr = as_col(left_length), as_col(right_length)
            cols += [(F.sum("n_left") / nl).alias("left_cardinality"), (F.sum("n_right") / nr).alias("right_cardinality"), (total / (nl + nr)).alias("overall_cardinality")]
        return self.sizes().agg(*cols)

    # look-ups and pairs

    def __getitem__(self, block_id) -> DataFrame:
        return self.wide().where(F.col("block_id") == str(block_id))

    def _side(self, side: str) -> tuple[DataFrame, DataFrame]:
        if side not in (self.left_name, self.right_name):
            raise ValueError(f"no side {side}")
        return (self.left, self.right) if side == self.left_name else (self.right, self.left)

    def find_blocks(self, entity_id, side: str) -> DataFrame:
        """Ids of blocks that hold the entity."""
        own, other = self._side(side)
        found = own.where(F.col("entity_id") == str(entity_id)).select("block_id")
        return found if self.one_sided else found.join(other.select("block_id"), "block_id", "left_semi")

    def entity_pairs(self, entity_id, side: str) -> DataFrame:
        """(entity, other), with duplicates over blocks."""
        own, other = self._side(side)
        return own.where(F.col("entity_id") == str(entity_id)).join(other.withColumnRenamed("entity_id", "other"), "block_id").select(F.col("entity_id").alias("entity"), "other")

    def pairs(self) -> DataFrame:
        """(block_id, left_id, right_id): all candidate pairs, with duplicates over blocks."""
        left = self.left.withColumnRenamed("entity_id", "left_id")
        return left.join(self.right.withColumnRenamed("entity_id", "right_id"), "block_id")

    def all_pairs(self) -> DataFrame:
        return self.pairs().select("left_id", "right_id")

    # forms

    def wide(self) -> DataFrame:
        """(block_id, <left>, <right>) with sorted arrays."""
        side = lambda d, n: d.groupBy("block_id").agg(F.array_sort(F.collect_set("entity_id")).alias(n))
        left, right = side(self.left, self.left_name), side(self.right, self.right_name)
        out = left.join(right, "block_id", "full_outer" if self.one_sided else "inner")
        empty = F.array().cast("array<string>")
        return out.select("block_id", *(F.coalesce(F.col(f"`{n}`"), empty).alias(n) for n in self.columns))

    @classmethod
    def from_wide(cls, df: DataFrame, one_sided: bool = False) -> BlockSet:
        key, left, right = df.columns
        side = lambda c: df.select(F.col(f"`{key}`").alias("block_id"), F.explode(F.col(f"`{c}`")).alias("entity_id"))
        return cls(side(left), side(right), left, right, one_sided)

    @classmethod
    def from_dict(cls, spark: SparkSession, blocks: Mapping, columns: tuple[str, str] = ("left", "right")) -> BlockSet:
        ids = T.ArrayType(T.StringType())
        schema = T.StructType([T.StructField("block_id", T.StringType()), *(T.StructField(c, ids) for c in columns)])
        rows = [(str(k), [str(x) for x in a], [str(x) for x in b]) for k, (a, b) in blocks.items()]
        return cls.from_wide(spark.createDataFrame(rows, schema))

    @classmethod
    def from_pandas(cls, spark: SparkSession, pdf) -> BlockSet:
        """A frame whose index holds block ids and whose two columns hold lists."""
        return cls.from_dict(spark, {k: (list(a), list(b)) for k, a, b in pdf.itertuples()}, tuple(pdf.columns))

    def to_dict(self) -> dict[str, tuple[list[str], list[str]]]:
        """Collects all blocks to the driver."""
        return {r[0]: (list(r[1]), list(r[2])) for r in self.wide().collect()}

    # operations

    def combine(self, other: BlockSet) -> BlockSet:
        """Blocks of either; members of a block in both are united."""
        if self.columns != other.columns:
            raise ValueError(f"blocks of {self.columns} and of {other.columns}")
        one_sided = self.one_sided or other.one_sided
        a, b = (self._closed(), other._closed()) if not one_sided else (self, other)
        return BlockSet(a.left.unionByName(b.left), a.right.unionByName(b.right), *self.columns, one_sided)

    def _closed(self) -> BlockSet:
        """Without members whose block has none on the other side: these must not meet another set's."""
        left = self.left.join(self.right.select("block_id").distinct(), "block_id", "left_semi")
        right = self.right.join(self.left.select("block_id").distinct(), "block_id", "left_semi")
        return BlockSet(left, right, *self.columns, distinct=False)

    def concat(self, other: BlockSet, tags: tuple[str, str] = ("0:", "1:")) -> BlockSet:
        """Blocks of both side by side; equal ids stay apart by their tags."""
        tag = lambda d, t: d.withColumn("block_id", F.concat(F.lit(t), "block_id"))
        side = lambda a, b: tag(a, tags[0]).unionByName(tag(b, tags[1]))
        return BlockSet(side(self.left, other.left), side(self.right, other.right), *self.columns, self.one_sided or other.one_sided, distinct=False)

    def purge_table(self, digits: int) -> DataFrame:
        """(card, running card, cc) of distinct block cardinalities; of blocks with one cardinality the least id stands for all."""
        cards = self.sizes().select("block_id", (F.col("n_left") * F.col("n_right")).alias("card"), (F.col("n_left") + F.col("n_right")).alias("size"))
        one = cards.groupBy("card").agg(F.min_by("size", "block_id").alias("size"))
        # distinct cardinalities are few: at most the square root of the pairs, about
        w = Window.orderBy("card").rowsBetween(Window.unboundedPreceding, 0)
        sums = one.select("card", F.sum("card").over(w).alias("running"), F.sum("size").over(w).alias("sizes"))
        return sums.select("card", "running", F.round(F.col("sizes") / F.col("running"), digits).alias("cc"))

    def purge_threshold(self, digits: int) -> DataFrame:
        """One row (threshold): the running sum of cardinalities where the rounded ratio first repeats, else the last one."""
        seen = F.row_number().over(Window.partitionBy("cc").orderBy("card"))
        return self.purge_table(digits).withColumn("seen", seen).agg(F.coalesce(F.min(F.when(F.col("seen") > 1, F.col("running"))), F.max("running")).alias("threshold"))

    def purge(self, digits: int) -> BlockSet:
        """Blocks of no more comparisons than the threshold."""
        # the memberships are counted once: the threshold, its test and the sizes that stay are of these counts
        self._sizes = settled(self.sizes())
        cut = F.broadcast(self.purge_threshold(digits))
        keep = self._sizes.crossJoin(cut).where(F.col("n_left") * F.col("n_right") <= F.col("threshold")).select("block_id", "n_left", "n_right")
        kept = self._only(keep)
        kept._sizes = keep
        return kept

    def iterative_threshold(self) -> DataFrame:
        """One row (threshold): ascending over distinct cardinalities, the first whose ratio of all blocks before it equals the one before, else the largest."""
        cards = self.sizes().select((F.col("n_left") * F.col("n_right")).alias("card"), (F.col("n_left") + F.col("n_right")).alias("size"))
        per = cards.groupBy("card").agg(F.sum("size").alias("size"), F.sum("card").alias("sum"))
        before = Window.orderBy("card").rowsBetween(Window.unboundedPreceding, -1)
        cc = per.select("card", F.try_divide(F.sum("size").over(before), F.sum("sum").over(before)).alias("cc"))
        prev = F.lag("cc").over(Window.orderBy("card"))
        return cc.withColumn("prev", prev).agg(F.coalesce(F.min(F.when(F.col("cc") == F.col("prev"), F.col("card"))), F.max("card")).alias("threshold"))

    def where(self, condition: Column) -> BlockSet:
        """Blocks whose block_id meets the condition."""
        out = BlockSet(self.left.where(condition), self.right.where(condition), *self.columns, self.one_sided, distinct=False)
        out._sizes = None if self._sizes is None else self._sizes.where(condition)
        return out

    def _only(self, block_ids: DataFrame) -> BlockSet:
        ids = block_ids.select("block_id").distinct()
        side = lambda d: d.join(ids, "block_id", "left_semi")
        return BlockSet(side(self.left), side(self.right), *self.columns, self.one_sided, distinct=False)


class ClassBlockSet(BlockSet):
    """A block for each right entity with the left ones linked to it, kept as links between classes.

    ``left`` and ``right`` are (id, class) with one row an id, ``links`` distinct
    (left_class, right_class). Sizes come from the classes; memberships are joined
    only where a later plan reads them.
    """

    def __init__(self, left: DataFrame, right: DataFrame, links: DataFrame, left_name: str = "left", right_name: str = "right"):
        text = lambda d: d.select(F.col("id").cast("string").alias("id"), "class")
        self.left_classes, self.right_classes, self.links = text(left), text(right), links
        near = links.join(self.left_classes.withColumnRenamed("class", "left_class"), "left_class").select("right_class", F.col("id").alias("left_id"))
        rows = self.right_classes.withColumnRenamed("class", "right_class").join(near, "right_class")
        linked = self.right_classes.withColumnRenamed("class", "right_class").join(links.select("right_class").distinct(), "right_class", "left_semi")
        super().__init__(rows.select(F.col("id").alias("block_id"), F.col("left_id").alias("entity_id")), linked.select(F.col("id").alias("block_id"), F.col("id").alias("entity_id")), left_name, right_name, distinct=False)

    def sizes(self) -> DataFrame:
        return self._united(self.left_classes, self.right_classes, [("class", self.links)])

    @staticmethod
    def _united(left: DataFrame, right: DataFrame, views: list[tuple[str, DataFrame]]) -> DataFrame:
        """(block_id, n_left, n_right) of left and right (id, a class for each view), linked by any view."""
        names = [c for c, _ in views]
        count = lambda d: d.groupBy(*names).agg(F.count("*").alias("n"))
        groups, wanted = count(left), right.select(*names).distinct()
        ends = lambda d, side: d.select(*(F.col(c).alias(f"{side}_{c}") for c in names), *(["n"] if "n" in d.columns else []))
        parts = []
        for k, (c, links) in enumerate(views):
            # each view's links to single groups of classes; those of a class of the other views are added, not listed
            own = links.withColumnsRenamed({"left_class": f"left_{c}", "right_class": f"right_{c}"})
            per = left.groupBy(F.col(c).alias(f"left_{c}")).agg(F.count("*").alias("n"))
            total = own.join(per, f"left_{c}").groupBy(F.col(f"right_{c}").alias(c)).agg(F.sum("n").alias("n"))
            parts.append(wanted.join(total, c).select(*names, "n"))
            if k:
                # and those that an earlier view has too are taken off
                first, earlier = views[0]
                rows = earlier.withColumnsRenamed({"left_class": f"left_{first}", "right_class": f"right_{first}"}).join(ends(groups, "left"), f"left_{first}").join(ends(wanted, "right"), f"right_{first}")
                twice = rows.join(own, [f"left_{c}", f"right_{c}"], "left_semi")
                parts.append(twice.select(*(F.col(f"right_{x}").alias(x) for x in names), (-F.col("n")).alias("n")))
        sums = parts[0]
        for p in parts[1:]:
            sums = sums.unionByName(p)
        sums = sums.groupBy(*names).agg(F.sum("n").alias("n_left")).where("n_left > 0")
        return right.join(sums, names).select(F.col("id").alias("block_id"), F.col("n_left").cast(BIG).alias("n_left"), F.lit(1).cast(BIG).alias("n_right"))

    def combine(self, other: BlockSet) -> BlockSet:
        """Sizes of two class sets are counted by classes too; everything else is as for all block sets."""
        out = super().combine(other)
        if type(other) is ClassBlockSet:
            def joint(a: DataFrame, b: DataFrame) -> DataFrame:
                # an entity without a class in one view has one that no link names
                rows = a.withColumnRenamed("class", "first").join(b.withColumnRenamed("class", "second"), "id", "full_outer")
                return settled(rows.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("first", "second"))))

            out._sizes = self._united(joint(self.left_classes, other.left_classes), joint(self.right_classes, other.right_classes), [("first", self.links), ("second", other.links)])
        return out


class NNBlockSet:
    """Neighbours (left_id, rank, right_id), rank from 0."""

    def __init__(self, df: DataFrame, left_name: str = "left", right_name: str = "right"):
        self.df = df.select(F.col("left_id").cast("string").alias("left_id"), F.col("rank").cast("int").alias("rank"), F.col("right_id").cast("string").alias("right_id"))
        self.left_name, self.right_name = left_name, right_name

    @property
    def columns(self) -> list[str]:
        return [self.left_name, self.right_name]

    def all_pairs(self) -> DataFrame:
        return self.df.where("right_id is not null").select("left_id", "right_id")

    def pairs(self) -> DataFrame:
        return self.df.where("right_id is not null").select(F.col("left_id").alias("block_id"), "left_id", "right_id")

    def n_neighbors(self) -> int:
        return (self.df.agg(F.max("rank")).first()[0] or 0) + 1

    def __len__(self) -> int:
        return self.df.select("left_id").distinct().count()

    def block_sizes(self) -> DataFrame:
        return self.df.groupBy(F.col("left_id").alias("block_id")).agg((F.count("right_id") + 1).alias("assignments"))

    def statistics(self, left_length: int, right_length: int) -> dict[str, float]:
        k = self.n_neighbors()
        return {
            "assignments": 1 + k, "comparisons": k, "left_cardinality": 1.0, "right_cardinality": k / right_length,
            "overall_cardinality": (left_length + k) / (left_length + right_length), "comparisons_cardinality": (1 + k) / k,
        }

    def combine(self, other: NNBlockSet) -> NNBlockSet:
        """The other's neighbours follow behind this one's ranks."""
        return NNBlockSet(self.df.unionByName(other.df.withColumn("rank", F.col("rank") + self.n_neighbors())), *self.columns)

    def wide(self) -> DataFrame:
        """One row for each left id, columns "0".."k-1"."""
        k = self.n_neighbors()
        return self.df.groupBy("left_id").pivot("rank", list(range(k))).agg(F.first("right_id")).withColumnRenamed("left_id", "block_id")

    @classmethod
    def from_wide(cls, df: DataFrame, left_name: str = "left", right_name: str = "right") -> NNBlockSet:
        key, *ranks = df.columns
        each = F.array(*(F.struct(F.lit(i).alias("rank"), F.col(f"`{c}`").cast("string").alias("right_id")) for i, c in enumerate(ranks)))
        return cls(df.select(F.col(f"`{key}`").alias("left_id"), F.explode(each).alias("n")).select("left_id", "n.rank", "n.right_id").where("right_id is not null"), left_name, right_name)


class CompositeBlockSet:
    """Blocks and neighbours side by side; pairs of both, duplicates kept."""

    def __init__(self, blocks: BlockSet, neighbors: NNBlockSet):
        self.blocks, self.neighbors = blocks, neighbors

    @property
    def columns(self) -> list[str]:
        return self.blocks.columns

    def pairs(self) -> DataFrame:
        return self.blocks.pairs().unionByName(self.neighbors.pairs())

    def all_pairs(self) -> DataFrame:
        return self.blocks.all_pairs().unionByName(self.neighbors.all_pairs())

    def pair_counts(self) -> DataFrame:
        """(left_id, right_id, n): distinct pairs and how often they occur.

        The pairs of a left entity of one block are distinct as they come from it, so
        they pass no shuffle: its neighbours come along, and say which pairs count more.
        Only pairs of entities of several blocks and those of neighbours are grouped.
        """
        blocks, near = self.blocks, settled(self.neighbors.all_pairs().where("left_id is not null").groupBy("left_id", "right_id").agg(F.count("*").alias("k")))
        left, right = settled(blocks.left), settled(blocks.right)
        own = left.groupBy("entity_id").agg(F.count("*").alias("blocks"), F.min("block_id").alias("block_id")).withColumnRenamed("entity_id", "left_id")
        # nulls in a pair are a group of groupBy too, but no neighbours
        listed = near.groupBy("left_id").agg(F.map_from_entries(F.collect_list(F.struct("right_id", "k"))).alias("near"))
        single = own.where("blocks = 1 and left_id is not null").drop("blocks")
        members = bounded(right.withColumnRenamed("entity_id", "right_id"))
        most = single.join(listed, "left_id", "left").join(members, "block_id")
        again = F.when(F.col("near").isNull(), F.lit(0)).otherwise(F.coalesce(F.try_element_at("near", F.col("right_id")), F.lit(0)))
        most = most.select("left_id", "right_id", (F.lit(1) + again).cast(BIG).alias("n"))
        # neighbours that share no block with their entity of one block
        apart = near.join(single, "left_id").join(members, ["block_id", "right_id"], "left_anti").select("left_id", "right_id", F.col("k").alias("n"))
        rest = left.withColumnRenamed("entity_id", "left_id").join(single.select("left_id"), "left_id", "left_anti").join(members, "block_id").select("left_id", "right_id", F.lit(1).cast(BIG).alias("n"))
        rest = rest.unionByName(near.join(single.select("left_id"), "left_id", "left_anti").withColumnRenamed("k", "n"))
        return most.unionByName(apart).unionByName(rest.groupBy("left_id", "right_id").agg(F.sum("n").alias("n")))


def combine_blocks(a, b):
    """Combines any two kinds."""
    kinds = isinstance(a, NNBlockSet), isinstance(b, NNBlockSet)
    if kinds == (True, False):
        return CompositeBlockSet(b, a)
    if kinds == (False, True):
        return CompositeBlockSet(a, b)
    return a.combine(b)

"""Relation triples: importance, top relations of an entity, text of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..metrics import harmonic_mean
from ..model import EntityFrame, TripleFrame, triples

OWN = "dummy_relation"


def reversed_relations(rel: DataFrame, prefix: str = "") -> DataFrame:
    t = triples(rel)
    return t.select(F.col("tail").alias("head"), F.concat(F.lit(prefix), "relation").alias("relation"), F.col("head").alias("tail"))


def entities(attr: DataFrame, rel: DataFrame) -> DataFrame:
    """(id): distinct heads of both, and tails of relations."""
    a, r = triples(attr), triples(rel)
    return a.select(F.col("head").alias("id")).unionAll(r.select("head")).unionAll(r.select("tail")).where("id is not null").distinct()


def count_entities(attr: DataFrame, rel: DataFrame) -> DataFrame:
    """One row (n)."""
    return entities(attr, rel).agg(F.count("*").alias("n"))


def importance(support: Column, discriminability: Column) -> Column:
    return harmonic_mean(support, discriminability)


def _scored(counted: DataFrame, n: DataFrame, top: Column) -> DataFrame:
    s = top.cast("double")
    rows = counted.crossJoin(F.broadcast(n)).select("relation", "rel_count", "tail_count", s.alias("support"), (F.col("tail_count") / F.col("rel_count")).alias("discriminability"))
    return rows.withColumn("importance", importance(F.col("support"), F.col("discriminability")))


def relation_importance(rel: DataFrame, n: DataFrame) -> DataFrame:
    """Support is rows over entities squared; discriminability the share of rows with a tail. n: one row (n)."""
    counted = triples(rel).groupBy("relation").agg(F.count("relation").alias("rel_count"), F.count("tail").alias("tail_count"))
    return _scored(counted, n, F.col("rel_count") / (F.col("n") * F.col("n")))


def name_importance(attr: DataFrame, n: DataFrame) -> DataFrame:
    """Support is heads over entities."""
    counted = triples(attr).groupBy("relation").agg(F.count("relation").alias("rel_count"), F.count("tail").alias("tail_count"), F.count("head").alias("head_count"))
    rows = counted.crossJoin(F.broadcast(n)).select("relation", "rel_count", "tail_count", (F.col("head_count") / F.col("n")).alias("support"), (F.col("tail_count") / F.col("rel_count")).alias("discriminability"))
    return rows.withColumn("importance", importance(F.col("support"), F.col("discriminability")))


def top_relations(rows: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """The triples of each head's n most important relations; ties by name of relation."""
    t = triples(rows)
    # scores have one row for a relation name; Spark broadcasts them if its statistics say they are small
    names = t.select("head", "relation").distinct().join(scores.select("relation", "importance"), "relation", "left")
    rank = F.row_number().over(Window.partitionBy("head").orderBy(F.desc_nulls_last("importance"), "relation"))
    keep = names.withColumn("rank", rank).where(F.col("rank") <= n).select("head", "relation")
    return t.join(keep, ["head", "relation"], "left_semi")


def attribute_texts(attr: EntityFrame) -> DataFrame:
    return attr.texts()


def neighbor_values(attr: EntityFrame, rel: DataFrame, own: bool = True, top_n_a: int | None = None, top_n_r: int | None = None) -> DataFrame:
    """(head, relation, tail): the attribute text of each neighbour along relations either way, and with ``own`` the entity's own."""
    edges = triples(rel).unionByName(reversed_relations(rel))
    n = None
    if top_n_a is not None or top_n_r is not None:
        base = attr.triples() if isinstance(attr, TripleFrame) else attr.texts().select(F.col("id").alias("head"), F.lit("").alias("relation"), F.col("text").alias("tail"))
        n = count_entities(base, rel)
    texts = attr.texts()
    if top_n_a is not None:
        if not isinstance(attr, TripleFrame):
            raise ValueError("top attributes need attribute triples")
        texts = X.concat_triples(top_relations(attr.triples(), name_importance(attr.triples(), n), top_n_a))
    if top_n_r is not None:
        edges = top_relations(edges, relation_importance(rel, n), top_n_r)
    found = edges.join(texts.withColumnRenamed("id", "tail"), "tail").select("head", "relation", F.col("text").alias("tail"))
    if own:
        found = found.unionByName(texts.select(F.col("id").alias("head"), F.lit(OWN).alias("relation"), F.col("text").alias("tail")))
    return found


def neighbor_texts(attr: EntityFrame, rel: DataFrame, own: bool = True, top_n_a: int | None = None, top_n_r: int | None = None) -> DataFrame:
    """(id, text) of the neighbours of each entity that has any with attributes."""
    return X.concat_triples(neighbor_values(attr, rel, own, top_n_a, top_n_r))


# importance by distinct counts


def instances(rows: DataFrame) -> DataFrame:
    """(relation, instances, subjects, objects): distinct pairs, heads and tails."""
    return triples(rows).groupBy("relation").agg(
        F.count_distinct(F.struct("head", "tail")).alias("instances"), F.count_distinct("head").alias("subjects"), F.count_distinct("tail").alias("objects")
    )


def distinct_relation_importance(rel: DataFrame, n: DataFrame) -> DataFrame:
    rows = instances(rel).crossJoin(F.broadcast(n)).select("relation", (F.col("instances") / (F.col("n") * F.col("n"))).alias("support"), (F.col("objects") / F.col("instances")).alias("discriminability"))
    return rows.withColumn("importance", importance(F.col("support"), F.col("discriminability")))


def distinct_name_importance(attr: DataFrame, n: DataFrame) -> DataFrame:
    rows = instances(attr).crossJoin(F.broadcast(n)).select("relation", (F.col("subjects") / F.col("n")).alias("support"), (F.col("objects") / F.col("instances")).alias("discriminability"))
    return rows.withColumn("importance", importance(F.col("support"), F.col("discriminability")))


def top_triples(rows: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """Each head's n triples of most importance: triples are counted, not relations; ties by relation and tail."""
    t = triples(rows).join(scores.select("relation", "importance"), "relation", "left")
    rank = F.row_number().over(Window.partitionBy("head").orderBy(F.desc_nulls_last("importance"), "relation", "tail"))
    return t.withColumn("rank", rank).where(F.col("rank") <= n).select("head", "relation", "tail")


def filtered_names(attr: DataFrame, n_entities: DataFrame, n: int, concat: bool = False) -> DataFrame:
    """Each entity's top names, as triples or as (id, text)."""
    rows = top_triples(attr, distinct_name_importance(attr, n_entities), n)
    return X.concat_triples(rows) if concat else rows


def filtered_neighbor_texts(attr: DataFrame, rel: DataFrame, n_entities: DataFrame, n: int, type_relation: str = "rdf:type", top_names: int | None = None) -> DataFrame:
    """(id, text): own text and that of neighbours along the n most important relations other than the type relation."""
    edges = triples(rel).where(F.col("relation") != type_relation)
    edges = top_triples(edges, distinct_relation_importance(edges, n_entities), n)
    texts = filtered_names(attr, n_entities, top_names, concat=True) if top_names else X.concat_triples(triples(attr))
    found = edges.join(texts.withColumnRenamed("id", "tail"), "tail").select("head", F.col("text").alias("tail"))
    return X.concat_triples(found.unionByName(texts.select(F.col("id").alias("head"), F.col("text").alias("tail"))))


def name_pairs(left: DataFrame, right: DataFrame, n_left: DataFrame, n_right: DataFrame, n: int) -> DataFrame:
    """(left_id, right_id, tail): entities whose top names have a value that occurs once on either side."""
    def once(attr, total):
        rows = filtered_names(attr, total, n)
        return rows.where("tail is not null").groupBy("tail").agg(F.count("*").alias("k"), F.min("head").alias("head")).where("k = 1").select("tail", "head")

    return once(left, n_left).withColumnRenamed("head", "left_id").join(once(right, n_right).withColumnRenamed("head", "right_id"), "tail").select("left_id", "right_id", "tail")


def filtered_neighbor_blocks(left: EntityFrame, right: EntityFrame, left_rel: DataFrame, right_rel: DataFrame, blocker, n: int, top_names: int | None = None):
    """Blocks of a text blocker over filtered neighbour texts; importance counts each side's own entities."""
    texts = [filtered_neighbor_texts(f.triples(), r, count_entities(f.triples(), r), n, top_names=top_names) for f, r in ((left, left_rel), (right, right_rel))]
    return blocker.assign_texts(*texts, left.name, right.name)

"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the
columns of ``documents``; the last one returns their pieces. What a stage decides
takes effect in the next: a rejected language, all but the least id of a class of
near duplicates and documents that leak benchmark items go, and secrets are
replaced in the texts.

Edge cases: null and empty texts have no language and go in the first stage;
without benchmark items nothing leaks; further columns of docs are kept until the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkblocks.llm import bagminhash, language, latent, pieces, secrets
from linkblocks.llm.common import hinted, table, text_or_empty, written

#: A language is rejected if it is unknown or its probability is below this.
LEAST_SCORE = 0.3


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of these ids; they are broadcast only if counted to be few."""
    return docs.join(hinted(ids.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    langs, net = language.learn(docs)
    found = written(language.predict(docs, langs, net))
    rejected = found.where((F.col("lang_pred") == language.UNKNOWN) | (F.col("score") < LEAST_SCORE))
    return _without(docs, rejected)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = written(bagminhash.near_duplicates(docs))
    kept = _without(docs, classes.where("class_id != doc_id"))
    # rows repeated under the id that stays are copies too
    again = classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("r")).select("doc_id", "r.*")
    return _without(kept, again).unionByName(once.select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = written(latent.leaks(docs, table(spark, sf_dir, "benchmark")))
    return _without(docs, leaks)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, findings, _ = secrets.scan(docs)
    # the row apart: columns of it may have any names
    named = docs.select(F.struct(*docs.columns).alias("row"), text_or_empty().alias("text")).withColumn("blob", F.sha2("text", 256))
    clean = secrets.redact(named, hinted(written(findings), size=128 + 40 * F.size("spans")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("sentencepiece", piece_stage),
]
#: Learnt stages and hashing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

import hashlib
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as C

from linkblocks.llm import language, secrets

from .test_bagminhash import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "", None, "s", 0), (9002, "123 456", "de", None, 7), (9003, "Well the password=abcdef12 is here and on the other hand it was for you", "en", "s", 5)], docs.schema)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = docs.unionByName(odd)
    rows = {r.doc_id: r for r in docs.collect()}
    kept = C.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {9000, 9001, 9002} and 9003 in ids
    assert len(ids) >= len(rows) - 8
    one = C.near_duplicate_stage(spark, kept, SF)
    label = brute([(i, rows[i].text) for i in sorted(ids)])
    assert {r.doc_id for r in one.collect()} == set(label.values())
    clean = C.decontamination_stage(spark, one, SF)
    left = {r.doc_id for r in clean.collect()}
    leaking = {i for i in set(label.values()) if any(x in rows[i].text for x in items)}
    assert left == set(label.values()) - leaking
    out = C.secret_stage(spark, clean, SF)
    assert out.columns == docs.columns
    for r in out.collect():
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text)
        if "[redacted]" not in r.text:
            assert r.text == rows[r.doc_id].text
    assert {r.doc_id: r.text for r in out.collect()}[9003] == "Well the [redacted] is here and on the other hand it was for you"
    last = C.piece_stage(spark, out, SF).collect()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_repeated_ids_keep_one_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    twice = docs.unionByName(docs)
    assert C.near_duplicate_stage(spark, twice, SF).count() == C.near_duplicate_stage(spark, docs, SF).count()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).count() == 0


def redacted(text):
    """Spans of all rules by Python's expressions, overlapping ones as one."""
    spans = []
    for r in secrets.RULES:
        for m in re.finditer(r.pattern, text, re.A):
            if not r.group or len(m[r.group]) >= r.least:
                spans.append(m.span())
    out, pos = "", 0
    for a, b in sorted(spans):
        if a >= pos:
            out += text[pos:a] + "[redacted]"
        pos = max(pos, b)
    return out + text[pos:]


def test_run_end_to_end(spark):
    """All stages one after the other, against brute force from the texts and the predicted languages."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    langs = {r.doc_id: r for r in language.op5_language_id(spark, SF).collect()}
    ids = sorted(i for i in docs if langs[i].lang_pred != language.UNKNOWN and langs[i].score >= C.LEAST_SCORE)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i for i in brute([(i, docs[i]) for i in ids]).values() if not any(x in docs[i] for x in items)}
    got = {r.doc_id: r for r in C.run(spark, SF).collect()}
    assert got.keys() == left
    for i, r in got.items():
        assert r.same and r.decoded_sha256 == hashlib.sha256(redacted(docs[i]).encode()).hexdigest()


def test_clashing_columns_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    more = docs.selectExpr("*", "'x' as blob", "1 as spans", "2 as class_id", "3 as rep", "4 as score", "'y' as lang_pred")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns and out.count() > 20
    assert C.piece_stage(spark, more.unionByName(more), SF).count() == 60

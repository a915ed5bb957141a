"""I-Match document fingerprints.

Terms are runs of letters and digits in lower case. The lexicon holds the terms
whose document frequency lies in a band of inverse document frequency, counted
over all documents. Each of ``SUBSETS`` randomised lexicons keeps a share of it;
a fingerprint is the list of hashes of a text's sorted distinct terms in each.
Two fingerprints are alike in the share of equal hashes among those subsets that
either text has terms in. JVM expressions only.

The lexicon is broadcast: a term in it is in at least ``low`` of all documents,
so its size is at most the mean number of distinct terms of a document over
``low``, whatever the number of documents. It is counted first, and beyond
``MOST`` terms a shuffled join is used.

Edge cases: a null text is empty; a text without a term in any subset has the
digest of the whole text as its fingerprint, which is alike (1.0) only to itself;
repeated rows each get a row; where rows with one id have other texts, the least in
byte order is what its predecessor borrows from; rows without an id give none; an only
document is its own successor; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

#: Terms in between these shares of all documents.
LOW, HIGH = 0.005, 0.05
SUBSETS = 16
#: Subset k keeps each term with a chance of 2 ** -SHIFTS[k % 4].
SHIFTS = (4, 5, 6, 7)
MOST = 500_000
NONE = "-"


def hashed_terms(text: Column) -> Column:
    """The 64-bit hashes of the distinct terms of a text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, subsets: int = SUBSETS) -> DataFrame:
    """(term, mask) of the band; bit k of mask: the term is in subset k. Terms in no subset are left out."""
    n = docs.count()
    df = docs.select(F.explode(hashed_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= max(1.0, low * n)) & (F.col("df") <= max(1.0, high * n)))
    bit = lambda k: F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(1 << SHIFTS[k % len(SHIFTS)])) == 0, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    mask = bit(0)
    for k in range(1, subsets):
        mask = mask.bitwiseOR(bit(k))
    return band.select("term", mask.alias("mask")).where("mask != 0")


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids in ascending order, the last one's next being the first.

    Ids are dealt to tasks by ranges, which are written so that they are drawn once;
    the next one is found within a range, or else it is the first of the range behind
    it. A window over all rows only sees one row a range, however the ids lie.
    """
    ids = written(ids.select("doc_id").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    heads = ids.groupBy("part").agg(F.min("doc_id").alias("head"))
    every = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(every), F.first("head").over(every.rowsBetween(Window.unboundedPreceding, 0))).alias("next_head"))
    inner = ids.withColumn("n", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return inner.join(F.broadcast(heads), "part").select("doc_id", F.coalesce("n", "next_head").alias("next_id"))


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_id, edited): the last quarter of each text gives way to as much of the beginning of the next one."""
    nexts = successors(docs)
    wants = docs.select("doc_id", F.floor(F.length("text") / 4).alias("k")).groupBy("doc_id").agg(F.max("k").alias("k")).join(nexts, "doc_id")
    wants = wants.select(F.col("doc_id").alias("prev"), F.col("next_id").alias("doc_id"), "k")
    # the longest prefix that any row of prev wants, of the least text
    lent = docs.join(wants, "doc_id").groupBy("prev", F.col("doc_id").alias("next_id")).agg(F.min(F.substring(F.col("text"), F.lit(1), F.col("k").cast("int"))).alias("head"))
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    changed = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("head"), F.lit(1), k))
    return docs.join(lent, docs["doc_id"] == lent["prev"]).select("doc_id", "text", "next_id", changed.alias("edited"))


def prints(terms: Column, subsets: int = SUBSETS) -> Column:
    """Sorted (term, mask) structs to one hash a subset, null where it has no term."""
    def one(k: int) -> Column:
        kept = F.transform(F.filter(terms, lambda t: t["mask"].bitwiseAND(F.lit(1 << k)) != 0), lambda t: t["term"])
        return F.when(F.exists(terms, lambda t: t["mask"].bitwiseAND(F.lit(1 << k)) != 0), F.xxhash64(F.lit(k), kept))

    return F.array(*(one(k) for k in range(subsets)))


def written_out(fp: Column, sha: Column) -> Column:
    empty = ~F.exists(fp, lambda x: x.isNotNull())
    return F.when(empty, F.concat(F.lit("text:"), sha)).otherwise(F.array_join(F.transform(fp, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit(NONE))), "."))


def likeness(a: Column, b: Column) -> Column:
    """Of two written fingerprints."""
    xs, ys = F.split(a, r"\."), F.split(b, r"\.")
    both = F.filter(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda z: (z["x"] != NONE) | (z["y"] != NONE))
    same = F.size(F.filter(both, lambda z: z["x"].eqNullSafe(z["y"])))
    return (same / F.size(both)).cast("double")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, subsets: int = SUBSETS) -> DataFrame:
    """(doc_id, next_id, n_chars, edited_sha256, fingerprint, edited_fingerprint) of docs (doc_id, text)."""
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    words = written(lexicon(docs, low, high, subsets))
    if words.count() <= MOST:
        words = F.broadcast(words)
    both = edited(docs).select(
        "doc_id", "next_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"), F.sha2("edited", 256).alias("edited_sha256"),
        hashed_terms(F.col("text")).alias("a"), hashed_terms(F.col("edited")).alias("b"),
    )
    # 1: only in the text, 2: only in the edited one, 3: both; 0 keeps texts without terms
    flag = lambda c, v: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(v).alias("of")))
    terms = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("term"), F.lit(0).alias("of"))), flag(F.array_except("a", "b"), 1), flag(F.array_except("b", "a"), 2), flag(F.array_intersect("a", "b"), 3))
    key = ["doc_id", "next_id", "n_chars", "sha", "edited_sha256"]
    rows = both.select(*key, F.explode(terms).alias("t")).select(*key, "t.term", "t.of")
    rows = rows.join(words, "term", "left").where("mask is not null or of = 0").withColumn("mask", F.when(F.col("of") == 0, F.lit(0).cast("long")).otherwise(F.col("mask")))
    # each row of docs has one term of kind 0
    found = rows.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("term", "mask", "of"))).alias("terms"), F.count_if(F.col("of") == 0).cast("int").alias("copies"))
    found = found.select(*key, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), F.filter("terms", lambda t: t["of"].bitwiseAND(F.lit(1)) != 0).alias("a"), F.filter("terms", lambda t: t["of"].bitwiseAND(F.lit(2)) != 0).alias("b"))
    found = found.select(*key, prints(F.col("a"), subsets).alias("a"), prints(F.col("b"), subsets).alias("b"))
    return found.select("doc_id", "next_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", written_out(F.col("a"), F.col("sha")).alias("fingerprint"), written_out(F.col("b"), F.col("edited_sha256")).alias("edited_fingerprint"))


def op3_imatch(spark, sf_dir: str) -> DataFrame:
    rows = written(fingerprints(table(spark, sf_dir, "documents")))
    after = rows.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fingerprint").alias("next_fingerprint"))
    return rows.join(after, "next_id").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )

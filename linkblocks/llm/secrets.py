"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is named by the SHA-256 of its text. The ledger is a
table that each run appends to: a row for a blob, the rule versions it was scanned
for, and what they matched. A blob is scanned once for each rule version that the
ledger does not hold for it yet; findings are read from the ledger and joined back to
all paths that carry the blob. Places of matches are running sums over rows, so a
text costs its length and its matches. JVM expressions only. The query begins a
ledger of its own; a caller that keeps one passes it to ``scan``.

Edge cases: a null text is an empty blob; empty texts have no findings; repeated
rows and exact copies share one scan and each row gets its result; extra columns
of the input are ignored; a blob that is in the ledger twice for one rule version,
after a run that failed between, counts once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, shared_dir, table, text_or_empty, written


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: least length of the group, where the pattern alone can't say it
    group: int = 0
    least: int = 0
    #: text without this string has no match
    needs: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A short value still uses up its text, so its length is checked after matching.
#: For the other two a bound in the pattern is the same: runs are maximal.
BASE = (
    Rule("assign", 1, ASSIGN, group=2, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
)
RULES = BASE + MORE
SPAN = "struct<start:int,rank:int,end:int,kind:string>"


LEDGER = "blob string, rules array<string>, marks array<struct<rule:string,i:int,gap:int,size:int,keep:boolean>>"


def _marks(rule: Rule) -> Column:
    """Matches m_<kind> and the text between them g_<kind> as lengths."""
    def one(m: Column, g: Column) -> Column:
        keep = F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least if rule.group else F.lit(True)
        return F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), keep.alias("keep"))

    # side by side, not by index: an array that a lambda looks into is made anew for each element
    both = F.filter(F.zip_with(f"m_{rule.kind}", f"g_{rule.kind}", one), lambda x: x["size"].isNotNull())
    return F.transform(both, lambda x, i: F.struct(F.lit(rule.key).alias("rule"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["keep"].alias("keep")))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, text, pending) -> (blob, rules, marks), rows of a ledger; only rules in pending run."""
    ms = {}
    for r in rules:
        wanted = F.array_contains("pending", r.key) & (F.contains("text", F.lit(r.needs)) if r.needs else F.lit(True))
        ms[f"m_{r.kind}"] = F.when(wanted, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = blobs.select("blob", "text", "pending", *(c.alias(n) for n, c in ms.items()))
    df = df.withColumns({f"g_{r.kind}": F.when(F.size(f"m_{r.kind}") > 0, F.split("text", r.pattern, -1)).otherwise(F.array().cast("array<string>")) for r in rules})
    return df.select("blob", F.col("pending").alias("rules"), F.concat(*(_marks(r) for r in rules)).alias("marks"))


class Ledger:
    """Blobs, the rule versions they were scanned for and what these matched: a table in a folder."""

    def __init__(self, spark, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_dir(spark)}/ledger/{uuid.uuid4().hex}"

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.folder)
        except AnalysisException:  # nothing was appended yet
            return self.spark.createDataFrame([], LEDGER)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.folder)

    def scanned(self) -> DataFrame:
        """(blob, seen): the rule versions each blob was scanned for."""
        return self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))

    def findings(self, rules=RULES) -> DataFrame:
        """(blob, spans) of the blobs with findings of these rule versions."""
        marks = self.rows().where(F.size("marks") > 0).select("blob", F.explode("marks").alias("m")).select("blob", "m.*")
        marks = marks.where(F.col("rule").isin([r.key for r in rules])).dropDuplicates(["blob", "rule", "i"])
        end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("i")).cast("int")
        which = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)))
        kind = F.create_map(*(F.lit(x) for r in rules for x in (r.key, r.kind)))
        placed = marks.withColumn("end", end).where("keep")
        span = F.struct((F.col("end") - F.col("size")).alias("start"), which[F.col("rule")].alias("rank"), "end", kind[F.col("rule")].alias("kind"))
        return placed.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan(versions: DataFrame, ledger: Ledger | None = None, rules=RULES, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, Ledger]:
    """Scans what the ledger lacks and appends it there.

    versions: one row for each version of each path. Returns (paths, findings,
    ledger): paths has (path, blob) for every row; findings (blob, spans) of all
    blobs of the ledger, of the present rule versions.
    """
    ledger = ledger or Ledger(versions.sparkSession)
    named = versions.select(F.col(path).alias("path"), text_or_empty(text).alias("text"))
    paths = named.select("path", F.sha2("text", 256).alias("blob"))
    # copies meet in the map-side part of this aggregation, so a hot blob is one row a task
    blobs = named.select(F.sha2("text", 256).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*(F.lit(r.key) for r in rules))
    before = ledger.rows()
    if before.isEmpty():
        blobs = blobs.withColumn("pending", every)
    else:
        left = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        blobs = blobs.join(ledger.scanned(), "blob", "left").withColumn("pending", left).where(F.size("pending") > 0)
    ledger.append(scan_blobs(blobs, rules))
    return paths, ledger.findings(rules), ledger


def findings_by_path(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, blob, spans) for every row of paths."""
    out = paths.join(findings, "blob", "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def rendered(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, findings: DataFrame, mask: str = "[redacted]") -> DataFrame:
    """docs (with columns text, blob) with every found span replaced by the mask; overlapping spans are one."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["pos"], F.concat(F.substring(F.col("text"), acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], gap).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    folded = F.aggregate("spans", zero, step)
    out = docs.join(findings, "blob", "left")
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(folded["out"], F.substring(F.col("text"), folded["pos"] + 1, F.length("text"))))
    return out.withColumn("text", clean).drop("spans")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    paths, findings, _ = scan(table(spark, sf_dir, "documents"))
    # a table of its own: few blobs have findings, and if many do, hot blobs can be split in the join
    rows = findings_by_path(paths, hinted(written(findings), size=128 + 40 * F.size("spans")))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        F.col("path").alias("doc_id"),
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(rendered(base), 256).alias("base_sha256"),
        rendered(F.col("spans")).alias("spans"),
        "blob",
    )


def _sql() -> str:
    """The same by splitting at matches, in DuckDB."""
    def one(rule: Rule, rank: int) -> str:
        rx = rule.pattern.replace("'", "''")
        keep = f"length(regexp_extract(ms[i], '{rx}', {rule.group})) >= {rule.least}" if rule.group else "true"
        return f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, s as s, s + length(ms[i]) as e from (
          select doc_id, ms, i, coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as s
          from (select doc_id, ms, gs, unnest(range(1, len(ms) + 1)) as i from (
            select doc_id, regexp_extract_all(t, '{rx}', 0) as ms, string_split_regex(t, '{rx}') as gs from d) where len(ms) > 0)) where {keep}"""

    found = "\n union all ".join(one(r, i) for i, r in enumerate(RULES))
    counts = ", ".join(f"cast(count(*) filter (where kind = '{r.kind}') as bigint) as n_{r.kind}" for r in BASE)
    joined = "string_agg(kind || ':' || cast(cast(s as bigint) as varchar) || ':' || cast(cast(e as bigint) as varchar), ',' order by s, rank)"
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), f as ({found}),
    g as (select doc_id, {counts}, {joined} filter (where rank < {len(BASE)}) as base, {joined} as spans from f group by doc_id)
    select d.doc_id, {zeros}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, sha256(t) as blob
    from d left join g on d.doc_id = g.doc_id"""


ORACLE_SQL = _sql()

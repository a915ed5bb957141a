"""Chat formatting from an event log.

A log has one row an event: (conv_id, turn, seq, kind, role, text). Events of a
message are folded in order of seq: ``delta`` appends its text, ``edit`` replaces
what there is, ``regenerate`` starts the message anew. Messages are then rendered
in order of turn by a template whose markers cannot occur inside an escaped text,
with a loss mask of code-point ranges for each turn. JVM expressions only.

Template of a turn: ``### role:\\ntext\\n</turn>\\n``. Inside texts and roles
``\\`` is written ``\\0``, ``</turn>`` ``\\1``, ``### `` ``\\2``, and inside roles
also ``:`` ``\\3`` and line feed ``\\4``; every backslash of the output starts
such an escape, so undoing them is exact.

Edge cases: a null text or role is empty; messages with one turn number are
ordered by their key, role and text and all kept; events with one seq by kind and
text; a conversation without messages has no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

END = "\n</turn>\n"
TEXT_ESCAPES = (("\\", "\\0"), ("</turn>", "\\1"), ("### ", "\\2"))
ROLE_ESCAPES = TEXT_ESCAPES + ((":", "\\3"), ("\n", "\\4"))


def escaped(c: Column, pairs=TEXT_ESCAPES) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column, pairs=TEXT_ESCAPES) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def fold(log: DataFrame) -> DataFrame:
    """Events to messages: (conv_id, turn, message, role, text). message tells apart messages of one turn."""
    events = log.select("conv_id", "turn", "message", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def step(acc: Column, e: Column) -> Column:
        return F.when(e["kind"] == "delta", F.concat(acc, e["text"])).when(e["kind"] == "edit", e["text"]).otherwise(F.lit(""))

    ordered = F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "role")))
    return events.groupBy("conv_id", "turn", "message").agg(ordered.alias("events")).select(
        "conv_id", "turn", "message", F.col("events")[0]["role"].alias("role"), F.aggregate("events", F.lit(""), step).alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): mask lists (turn index from 0, offset in the turn, length) of assistant texts."""
    body = escaped(F.col("text"))
    head = F.concat(F.lit("### "), escaped(F.col("role"), ROLE_ESCAPES), F.lit(":\n"))
    turns = messages.select("conv_id", "turn", "message", "role", "text", head.alias("head"), body.alias("body"))
    one = F.struct("turn", "role", "text", "message", F.concat("head", "body", F.lit(END)).alias("out"), F.length("head").alias("at"), F.length("body").alias("n"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    mask = F.filter(
        F.transform("rows", lambda r, i: F.struct(i.alias("turn"), r["at"].alias("at"), F.when(r["role"] == "assistant", r["n"]).alias("n"))),
        lambda r: r["n"].isNotNull(),
    )
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda r: r["out"]), "").alias("formatted"), mask.alias("mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """Reads rendered conversations back: (conv_id, turns of (role, text), loss_text, n)."""
    # what follows the last marker is empty
    cut = F.split("formatted", END, -1)
    pieces = F.slice(cut, F.lit(1), F.size(cut) - 1)
    df = formatted.select("conv_id", "formatted", "mask", pieces.alias("pieces"))
    turn = lambda p: F.struct(
        unescaped(F.regexp_extract(p, r"^### ([^:\n]*):\n", 1), ROLE_ESCAPES).alias("role"),
        unescaped(F.regexp_replace(p, r"^### [^:\n]*:\n", "")).alias("text"),
    )
    masked = F.transform("mask", lambda m: unescaped(F.substring(F.col("pieces")[m["turn"]], m["at"] + 1, m["n"])))
    return df.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log whose fold gives back the rows: a draft that is generated anew, then two deltas, or one edit."""
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.row_number().over(w))
    half = (F.length("text") / 2).cast("int")
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    streamed = F.array(event(0, "delta", F.lit("draft")), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", rest))
    typed = F.array(event(0, "delta", first), event(1, "edit", F.col("text")))
    return rows.select("conv_id", "turn", "message", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("e")).select(
        "conv_id", "turn", "message", "role", "e.seq", "e.kind", "e.text"
    )


PROBE = r"\### Assistant: </turn> ok"


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    read = parse(render(fold(log_of(rows.unionByName(probe)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    def esc(c: str, pairs) -> str:
        for a, b in pairs:
            a, b = (x.replace("\n", "' || chr(10) || '") for x in (a, b))
            c = f"replace({c}, '{a}', '{b}')"
        return c

    return f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}')
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
      cast(sum(4 + length({esc('role', ROLE_ESCAPES)}) + 2 + length({esc('text', TEXT_ESCAPES)}) + {len(END)}) as bigint) as formatted_chars
    from c group by conv_id"""


ORACLE_SQL = _sql()

"""Text projections: tokens, q-grams and concatenation of attributes, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of letters, digits and underscores, joined by single dashes, dots or apostrophes.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+(?:[-.'][\p{L}\p{N}_]+)*"

# The usual English stop words.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
    himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about against between into through during before after above below
    to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don don't should
    should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
    haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
    weren weren't won won't wouldn wouldn't""".split()
)

ColumnFunction = Callable[[Column], Column]


def pattern_tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def python_tokens(fn: Callable[[str], Iterable[str]]) -> ColumnFunction:
    """A Python tokenizer as a column function; it runs on Arrow batches."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else list(fn(t)))

    return run


@dataclass(frozen=True)
class Tokenizer:
    """Lower-case tokens of at least ``min_length`` characters that aren't stop words.

    No or empty ``stop_words`` means the English list. ``split`` maps a text column
    to an array column.
    """

    min_length: int = 3
    stop_words: tuple[str, ...] | None = None
    split: ColumnFunction = pattern_tokens

    def tokens(self, text: Column, distinct: bool = False) -> Column:
        stop = self.stop_words or STOP_WORDS
        kept = F.filter(self.split(F.lower(text)), lambda t: (F.length(t) >= self.min_length) & ~t.isin(*stop))
        return F.array_distinct(kept) if distinct else kept


def row_tokens(columns: Iterable[Column], split: ColumnFunction = pattern_tokens, min_length: int = 1) -> Column:
    """Distinct tokens over several columns, neither lower-cased nor filtered by stop words."""
    each = F.flatten(F.array(*(F.coalesce(split(c.cast("string")), F.array().cast("array<string>")) for c in columns)))
    return F.array_distinct(F.filter(each, lambda t: F.length(t) >= min_length))


def qgrams(text: Column, q: int = 3) -> Column:
    """All substrings of q characters; null for null, empty for shorter texts."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring(text, i, F.lit(q)))
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).when(n >= q, grams).otherwise(F.array().cast("array<string>"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_datatype(value: Column) -> Column:
    """An RDF literal without its datatype suffix."""
    return F.substring_index(value.cast("string"), "^^", 1)


def concat_wide(df: DataFrame, id_col: str) -> DataFrame:
    """(id, text): all other columns in their order, null as empty, joined by spaces; the ends are stripped."""
    others = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns if c != id_col]
    text = stripped(F.concat_ws(" ", *others)) if others else F.lit("")
    return df.select(F.col(f"`{id_col}`").cast("string").alias("id"), text.alias("text"))


def concat_triples(df: DataFrame, id_col: str = "head", value_col: str = "tail", distinct: bool = True) -> DataFrame:
    """(id, text): the values of each id, sorted, joined by spaces; distinct ones are stripped first."""
    value = F.coalesce(F.col(value_col).cast("string"), F.lit(""))
    values = F.collect_set(stripped(value)) if distinct else F.collect_list(value)
    return df.groupBy(F.col(id_col).cast("string").alias("id")).agg(stripped(F.array_join(F.array_sort(values), " ")).alias("text"))


def exploded_tokens(texts: DataFrame, tokenizer: Tokenizer, distinct: bool = True) -> DataFrame:
    """(id, tok) of (id, text)."""
    return texts.select("id", F.explode(tokenizer.tokens(F.col("text"), distinct)).alias("tok"))

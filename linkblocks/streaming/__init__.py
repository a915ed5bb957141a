"""Blocking of arriving entities against a table at rest, as stream-static joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, exploded_tokens
from ..operators.lsh import MinHashLSHBlocker, band_rows


def token_index(texts: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(tok, right_id) of a table at rest (id, text), to be written once and read by streams."""
    return exploded_tokens(texts, tokenizer or Tokenizer()).select("tok", F.col("id").alias("right_id"))


def token_candidates(arriving: DataFrame, index: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(left_id, right_id, tok) for a stream or a table (id, text); stateless."""
    return exploded_tokens(arriving, tokenizer or Tokenizer()).join(index, "tok").select(F.col("id").alias("left_id"), "right_id", "tok")


def band_index(texts: DataFrame, lsh: MinHashLSHBlocker) -> DataFrame:
    return band_rows(texts, lsh.tokenizer, lsh.bands, lsh.rows, lsh.seed).select("band", F.col("id").alias("right_id"))


def band_candidates(arriving: DataFrame, index: DataFrame, lsh: MinHashLSHBlocker) -> DataFrame:
    """(left_id, right_id, band); a pair appears for each band it shares."""
    return band_rows(arriving, lsh.tokenizer, lsh.bands, lsh.rows, lsh.seed).join(index, "band").select(F.col("id").alias("left_id"), "right_id", "band")

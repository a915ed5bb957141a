"""Tokens of texts with their counts, a row a text: nothing is shuffled to count them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import stored

#: So many frequent tokens are known to all executors; the others are looked up by a shuffle.
FREQUENT = 200_000


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of lists one after the other, and the row of each."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), n)


def lists(values: pa.Array, row: np.ndarray, rows: int) -> pa.ListArray:
    """Lists of a column's rows from elements in the order of rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def _count(batches):
    for b in batches:
        toks, row = flat(b.column(b.schema.get_field_index("toks")))
        coded = toks.dictionary_encode()
        size = max(1, len(coded.dictionary))
        found, n = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, kept = found // size, coded.dictionary.take(pa.array(found % size))
        out = [lists(x, row, b.num_rows) for x in (kept, pa.array(n.astype(np.int64)))]
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), *out], ["id", "toks", "ns"])


def repeated_ids(texts: DataFrame) -> bool:
    return not texts.groupBy("id").count().where("count > 1").isEmpty()


def counted(texts: DataFrame, tokens: Column) -> DataFrame:
    """(id, toks, ns) of (id, text): distinct tokens and how often each occurs; an id of several texts has several rows."""
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{16 << 20}b")
    rows = texts.select("id", tokens.alias("toks"))
    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(_count, f"id {kind}, toks array<string>, ns array<bigint>"))


def frequent(held: DataFrame) -> DataFrame:
    """(tok, df, n) of the tokens of most texts; how many texts have them, and how often they occur in all."""
    each = held.select(F.explode(F.arrays_zip("toks", "ns")).alias("t"))
    return each.groupBy(F.col("t.toks").alias("tok")).agg(F.count("*").alias("df"), F.sum("t.ns").alias("n")).orderBy(F.desc("df"), "tok").limit(FREQUENT)

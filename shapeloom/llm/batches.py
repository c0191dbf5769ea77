"""Small helpers for Arrow batches of documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one batch that a function gives back.
OUT_ROWS = 4096


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text becomes empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pieces_of(batches: Iterable[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about max_bytes at most, for bounded memory with very long texts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that differ in id or text; a null id and a null text (taken as empty) are values like others."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), sha256_hex(F.coalesce(text, F.lit(""))))


def only_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose row_key is in keys (one column); one of the rows that repeat id and text."""
    name = "row_key" if "row_key" not in docs.columns else "row_key_" + "_".join(docs.columns)
    keyed = docs.withColumn(name, row_key(F.col("doc_id"), F.col("text")))
    rows = keyed.join(keys.toDF(name).hint("shuffle_hash"), name, "left_semi")
    return rows.dropDuplicates([name]).select(docs.columns)

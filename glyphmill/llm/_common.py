"""Helpers shared by the corpus operators: tables, scratch space, Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import materialise, scratch_dir  # noqa: F401  the operators take them from here

#: Characters that separate words, as a Java character class body.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[str]:
    """The column's whole texts, null as empty."""
    return [t or "" for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, text_bytes: int = 8 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about text_bytes of the column `text` (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    rows = batch.num_rows
    if rows == 0:
        return
    mean = max(1, column.nbytes // rows)
    step = max(1, min(rows, text_bytes // mean))
    for start in range(0, rows, step):
        yield batch.slice(start, min(step, rows - start))


def hashed_order(column: str) -> F.Column:
    """A uniform 60-bit integer from a key; the same value in SQL: ('0x' || left(md5(key), 15))::BIGINT."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")

"""Reading order from block coordinates, character offsets, page finalisation, text by range."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A block joins a visual row while it is within this share of the lower height, and at least so many pixels, of its anchor.
ROW_SHARE, ROW_LEAST = 0.35, 3
LEAST_HEIGHT = 640


def _lines(at: dict[str, int]):
    """The anchor rule over rows that come sorted by page, y, x and id; only the open row's anchor is held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: object = None
        ay = ah = line = -1
        begun = False
        for batch in batches:
            out = []
            for p, y, h in zip(*(batch.column(at[c]).to_pylist() for c in ("page", "y", "h")), strict=True):
                if not begun or p != page:
                    page, ay, ah, line, begun = p, y, h, 0, True
                elif None in (y, h, ay, ah) or abs(y - ay) > max(ROW_LEAST, int(min(ah, h) * ROW_SHARE)):
                    ay, ah, line = y, h, line + 1
                out.append(line)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "line"])

    return fold


def visual_rows(blocks: DataFrame, page: str) -> DataFrame:
    """blocks (page, id, x, y, h) with `line`, the 0-based visual row.

    A row is anchored on its first block, not on the block before, which no window expresses: sorted blocks run through a
    fold that holds one anchor, linear in the blocks whatever the size of a page. One shuffle, no join back.
    """
    placed = blocks.repartition(page).sortWithinPartitions(page, "y", "x", "id")
    at = {"page": blocks.columns.index(page), "y": blocks.columns.index("y"), "h": blocks.columns.index("h")}
    return placed.mapInArrow(_lines(at), T.StructType(list(blocks.schema.fields)).add("line", T.IntegerType()))


def char_offsets(placed: DataFrame, page: str, length: Column) -> DataFrame:
    """placed blocks with char_start and char_end within their line, blocks in order of (x, id)."""
    line = Window.partitionBy(page, "line").orderBy("x", "id")
    before = F.coalesce(F.sum(length).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("char_start", before.cast("long")).withColumn("char_end", (F.col("char_start") + length).cast("long"))


def page_lines(placed: DataFrame, page: str, text: str) -> DataFrame:
    """(page, line, text, ids): each visual row's text and block ids from left to right."""
    grouped = placed.groupBy(page, "line").agg(F.array_sort(F.collect_list(F.struct("x", "id", F.col(text).alias("t")))).alias("_b"))
    return grouped.select(page, "line", F.array_join(F.transform("_b", lambda b: b["t"]), "").alias("text"), F.transform("_b", lambda b: b["id"]).alias("ids"))


def canvas_heights(blocks: DataFrame, page: str, margin: int) -> DataFrame:
    """(page, canvas_height): the lowest edge and the margin, LEAST_HEIGHT at least."""
    return blocks.groupBy(page).agg(F.greatest(F.lit(LEAST_HEIGHT), F.max(F.col("y") + F.col("h")) + margin).cast("long").alias("canvas_height"))


def block_texts(blocks: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """Blocks (line, char_start, char_end) with the text of their range in the line's current text."""
    own = lines.select(page, "line", F.col("text").alias("_t"))
    return blocks.join(own, [page, "line"]).withColumn("text", F.substring(F.col("_t"), F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))).drop("_t")

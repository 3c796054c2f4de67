"""Readers and writers: JSON lines, JSON documents, CSV, text lists, images as bytes, staged publishing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.functions import text as t


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lenient: blank lines are skipped, missing fields are null."""
    return spark.read.schema(schema).json(path)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of text files with their numbers from 1, as a sequential reader would count them.

    A file is read in as many splits as Spark likes. Within a split lines come in order, so a line's number is its distance
    from the split's first line plus the lines of the file's earlier splits: one count for each split, summed up over a
    file's splits. No line is shuffled unless there are too many splits for Spark to send their counts to all tasks. Lines
    end at \\n, \\r or both. An empty file has no lines.
    """
    split = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("_at"))
    sizes = lines.groupBy("path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("path", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = lines.join(bases, ["path", "_block"])
    return joined.select("path", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long").alias("line"), "value")


#: White space as a line reader's strip() sees it.
_BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def _line_problem(value: Column) -> Column:
    """What is wrong with a line as a JSON object, null if nothing: a blank line isn't wrong, it is skipped.

    Spark's JSON functions stop after the first value, so the line is read as the first of two members of an object: what
    follows its value, a bracket too many or a further member shows in the object's keys.
    """
    keys = F.json_object_keys(F.concat(F.lit('{"v":'), value, F.lit(',"end":0}')))
    opened = value.rlike(r"^[ \t\r]*\{")
    double = F.from_json(value, "map<string,string>", {"allowSingleQuotes": "false"}).isNotNull()
    valid = F.coalesce(keys == F.array(F.lit("v"), F.lit("end")), F.lit(False)) & (~opened | double)
    return F.when(value.rlike(_BLANK), F.lit(None)).when(~valid, F.lit("not valid JSON")).when(~opened, F.lit("not a JSON object"))


def json_line_problems(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, problem): every line of the files that a strict reader refuses. Blank lines are fine."""
    found = read_numbered_lines(spark, path).withColumn("problem", _line_problem(F.col("value")))
    return found.filter("problem is not null").select("path", "line", "problem")


def read_json_lines_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Every non-blank line must be a JSON object, or the run fails with `path:line: what is wrong`.

    A failing run names the first bad line that a task met; json_line_problems lists them all.
    """
    lines = read_numbered_lines(spark, path).filter(~F.col("value").rlike(_BLANK)).withColumn("_problem", _line_problem(F.col("value")))
    fail = F.raise_error(F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("_problem")))
    return lines.select(F.from_json(F.when(F.col("_problem").isNull(), F.col("value")).otherwise(fail), schema).alias("r")).select("r.*")


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object, or the objects of one array, spread over many lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_dimension(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV table with a header; rows without the key go. A byte order mark before the header is dropped."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    if key not in rows.columns:
        raise ValueError(f"{path} has no column {key}")
    return rows.filter(F.coalesce(F.trim(key), F.lit("")) != "")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): one entry for each line that isn't blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, digest, length): bytes are the boundary; decoding is up to the caller."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("digest"), "length")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def canonical_lines(rows: DataFrame) -> DataFrame:
    """(value): compact JSON with sorted keys, nulls written."""
    return rows.select(t.canonical_json(rows.columns).alias("value"))


def write_canonical_lines(rows: DataFrame, path: str) -> None:
    canonical_lines(rows).write.mode("errorifexists").text(path)


def write_list(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string")).write.mode("errorifexists").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def union_by_name(*tables: DataFrame) -> DataFrame:
    """All rows; columns in the order of first appearance, missing ones null."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_document(spark: SparkSession, document: Mapping[str, Any] | list, path: str) -> None:
    """An indented JSON document with sorted keys, through the cluster's file system."""
    system, where = _file_system(spark, path)
    out = system.create(where, False)
    try:
        out.write(bytearray((json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n").encode()))
    finally:
        out.close()


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], target: str, manifest: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Write all tables and a manifest to a staging folder and rename it: the target appears whole or not at all.

    Refuses to overwrite; the staging folder goes if anything fails. The manifest has each table's rows and digest: the
    sum over rows of a 64-bit hash, which doesn't depend on the order.
    """
    system, final = _file_system(spark, target)
    if system.exists(final):
        raise FileExistsError(target)
    stage = f"{target}.staging"
    try:
        outputs = {}
        for name, rows in tables.items():
            write_canonical_lines(rows, f"{stage}/{name}")
            lines = spark.read.text(f"{stage}/{name}")
            n, digest = lines.agg(F.count("*"), F.sum(F.xxhash64("value").cast("decimal(38,0)"))).first()
            outputs[name] = {"rows": n, "digest": str(digest)}
        document = {**(manifest or {}), "outputs": outputs}
        write_document(spark, document, f"{stage}/manifest.json")
        if not system.rename(_file_system(spark, stage)[1], final):
            raise OSError(f"can't rename {stage}")
        return document
    except BaseException:
        system.delete(_file_system(spark, stage)[1], True)
        raise


def write_ranked_parts(rows: DataFrame, rank: str, path: str) -> None:
    """JSON lines in a folder for each rank, as that many writers would leave them."""
    rows.write.mode("errorifexists").partitionBy(rank).json(path)


def read_ranked_parts(spark: SparkSession, path: str, schema: StructType | str, rank: str, order: str) -> DataFrame:
    """The parts merged, with `position`: rows in the order of ranks, and of `order` within a rank.

    A position is the number of rows of the ranks before (one count a rank, a small dimension) and the place within.
    """
    parts = spark.read.schema(schema).json(path)
    before = Window.partitionBy(F.lit(0)).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy(rank).agg(F.count("*").alias("_n")).select(rank, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(rank).orderBy(order)) - 1
    return parts.join(F.broadcast(bases), rank).withColumn("position", (F.col("_base") + within).cast("long")).drop("_base")


def write_array_documents(rows: DataFrame, part: str, order: str, path: str) -> None:
    """A JSON array for each value of `part`, its rows' other columns as objects in the given order, each in a file of its own
    below path/part=value. One task builds an array, so a part must be a bounded number of rows; parts are spread."""
    one = F.to_json(F.struct(*(c for c in rows.columns if c != part)), {"ignoreNullFields": "false"})
    made = rows.groupBy(part).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("j")))).alias("_a"))
    made.select(part, F.concat(F.lit("["), F.array_join(F.transform("_a", lambda x: x["j"]), ",\n"), F.lit("]")).alias("value")).write.mode("errorifexists").partitionBy(part).text(path)


def write_row_documents(rows: DataFrame, part: str, path: str) -> None:
    """An indented JSON object for each row, in a file of its own below path/part=value."""
    shown = F.to_json(F.struct(*(c for c in rows.columns if c != part)), {"pretty": "true", "ignoreNullFields": "false"})
    rows.select(part, shown.alias("value")).repartition(part).write.mode("errorifexists").partitionBy(part).text(path)


def bank_digests(pairs: DataFrame, bank: str, order: list[str]) -> DataFrame:
    """(bank, digest): the digest of each bank as pair_bank_digest would give it for its rows alone, on the executors. A bank
    is bounded: one task holds its text."""
    columns = [c for c in pairs.columns if c != bank]
    listed = [F.to_json(F.array(F.col(c)), {"ignoreNullFields": "false"}) for c in columns]  # a value as JSON, in brackets
    fields = [F.concat(F.lit(f'    "{c}": '), F.substring(j, F.lit(2), F.length(j) - 2)) for c, j in zip(columns, listed, strict=True)]
    shown = F.concat(F.lit("  {\n"), F.array_join(F.array(*fields), ",\n"), F.lit("\n  }"))
    held = pairs.groupBy(bank).agg(F.sort_array(F.collect_list(F.struct(*order, shown.alias("_t")))).alias("_a"))
    text = F.concat(F.lit("[\n"), F.array_join(F.transform("_a", lambda x: x["_t"]), ",\n"), F.lit("\n]\n"))
    return held.select(bank, F.sha2(text, 256).alias("digest"))


def summaries(rows: DataFrame, title: str, metrics: list[str]) -> DataFrame:
    """(title, text): each row as a Markdown summary, a bullet for each metric."""
    bullets = [F.concat(F.lit(f"- {m}: "), F.coalesce(F.col(m).cast("string"), F.lit("None")), F.lit("\n")) for m in metrics]
    return rows.select(title, F.concat(F.lit("# "), F.col(title).cast("string"), F.lit("\n\n"), *bullets).alias("text"))


def review_pages(rows: DataFrame, group: str, columns: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """(group, html): a table of each group's first rows in their order. The limit is applied before and after the shuffle, so
    a task holds `limit` rows of a group however large the group is."""
    cells = F.concat(*(F.concat(F.lit("<td>"), t.escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= limit)
    held = first.select(group, "_n", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("_r")).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_n", "_r"))).alias("_a"))
    head = "".join(f"<th>{c}</th>" for c in columns)
    name = t.escaped(F.col(group).cast("string"))
    return held.select(group, F.concat(F.lit("<!doctype html><meta charset='utf-8'><title>"), name, F.lit(f"</title><table><tr>{head}</tr>\n"), F.array_join(F.transform("_a", lambda x: x["_r"]), "\n"), F.lit("</table>\n")).alias("html"))


def bar_charts(rows: DataFrame, group: str, name: str, value: str, width: int = 480) -> DataFrame:
    """(group, svg): a plain bar chart of each group's values, by name. A group is a bounded summary."""
    held = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(name).cast("string").alias("n"), F.col(value).cast("double").alias("v")))).alias("_a"), F.greatest(F.lit(1e-12), F.max(F.col(value).cast("double"))).alias("_m"))

    def bar(x: Column, i: Column) -> Column:
        size = x["v"] / F.col("_m") * (width - 220)
        label = F.concat(F.format_string("<text x='0' y='%d'>", i * 24 + 30), t.escaped(x["n"]))
        return F.concat(label, F.format_string("</text><rect x='140' y='%d' width='%.1f' height='16'/><text x='%.1f' y='%d'>%.4f</text>", i * 24 + 18, size, size + 150, i * 24 + 30, x["v"]))

    head = F.format_string("<svg xmlns='http://www.w3.org/2000/svg' width='%d' height='%d'><title>", F.lit(width), F.size("_a") * 24 + 40)
    return held.select(group, F.concat(head, t.escaped(F.col(group).cast("string")), F.lit("</title>"), F.array_join(F.transform("_a", bar), ""), F.lit("</svg>\n")).alias("svg"))


def pair_bank_digest(pairs: DataFrame, order: list[str]) -> str:
    """SHA-256 of the bank as one indented JSON array in the given order. A bank is a small dimension."""
    rows = [{c: r[c] for c in pairs.columns} for r in pairs.orderBy(*order).toLocalIterator()]
    return hashlib.sha256((json.dumps(rows, ensure_ascii=False, indent=2) + "\n").encode()).hexdigest()


def review_page(rows: DataFrame, columns: list[str], title: str, limit: int) -> str:
    """An HTML table of the first rows in their order: a bounded report."""
    cells: Column = F.concat(*(F.concat(F.lit("<td>"), t.escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns))
    body = "\n".join(f"<tr>{r[0]}</tr>" for r in rows.limit(limit).select(cells).toLocalIterator())
    head = "".join(f"<th>{c}</th>" for c in columns)
    return f"<!doctype html><meta charset='utf-8'><title>{title}</title><table><tr>{head}</tr>\n{body}</table>\n"


def summary_markdown(metrics: Mapping[str, Any], title: str) -> str:
    """A bullet for each metric of a one-row summary."""
    return "\n".join([f"# {title}", "", *(f"- {k}: {v}" for k, v in metrics.items()), ""])


def bar_chart(values: Mapping[str, float], title: str, width: int = 480) -> str:
    """A plain SVG bar chart of a small summary."""
    most = max([1e-12, *values.values()])
    bars = "".join(
        f"<text x='0' y='{30 + 24 * i}'>{name}</text><rect x='140' y='{18 + 24 * i}' width='{v / most * (width - 220):.1f}' height='16'/><text x='{150 + v / most * (width - 220):.1f}' y='{30 + 24 * i}'>{v:.4f}</text>"
        for i, (name, v) in enumerate(values.items())
    )
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{40 + 24 * len(values)}'><title>{title}</title>{bars}</svg>\n"

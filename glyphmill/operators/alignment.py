"""Texts of samples and predictions, and the joins that pair them under explicit key rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.session import materialise

#: Metadata columns of a sample and their values where they are missing.
META_DEFAULTS = {
    "source_name": "",
    "source_code": "",
    "sample_type": "",
    "script_mix": "",
    "difficulty": "",
    "scene": "",
    "source_category": "",
    "has_digit": False,
    "original_id": "",
}


def _assistant(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] == "assistant")


def assistant_text(messages: Column, label: Column | None = None) -> Column:
    """Lenient: the label if there is one, else the last assistant message, else empty."""
    last = F.try_element_at(_assistant(messages), F.lit(-1))["content"]
    return F.coalesce(*([label] if label is not None else []), last, F.lit(""))


def assistant_text_strict(messages: Column) -> Column:
    """Exactly one assistant message with a text, or an error."""
    found = _assistant(messages)
    one = (F.size(found) == 1) & found[0]["content"].isNotNull()
    return F.when(F.coalesce(one, F.lit(False)), found[0]["content"]).otherwise(F.raise_error(F.lit("a row needs exactly one assistant message")))


def answer_text(answer: Column) -> Column:
    return F.coalesce(answer, F.lit(""))


def first_text(rows: DataFrame, *paths: str) -> Column:
    """The first non-null of the paths that the schema has; null if it has none."""
    have = [F.col(p) for p in paths if _has(rows, p)]
    return F.coalesce(*have, F.lit(None).cast("string"))


def _has(rows: DataFrame, path: str) -> bool:
    kind = rows.schema
    for name in path.split("."):
        if not hasattr(kind, "fieldNames") or name not in kind.fieldNames():
            return False
        kind = kind[name].dataType
    return True


def prediction_text(rows: DataFrame) -> Column:
    """prediction, answer or assistant, else the only assistant message."""
    direct = first_text(rows, "prediction", "answer", "assistant")
    return F.when(direct.isNotNull(), direct).otherwise(assistant_text_strict(F.col("messages"))) if "messages" in rows.columns else direct


def _digest(found: Column, kind: str) -> Column:
    return F.when(F.length(found) == 64, found).otherwise(F.raise_error(F.lit(f"{kind}: missing image SHA-256")))


def annotation_digest(rows: DataFrame) -> Column:
    return _digest(first_text(rows, "meta.image.sha256"), "annotation")


def prediction_digest(rows: DataFrame) -> Column:
    return _digest(first_text(rows, "meta.image_sha256", "meta.evaluation_image_sha256", "meta.inference_image_sha256", "meta.image.sha256"), "prediction")


def flat_meta(rows: DataFrame) -> dict[str, Column]:
    """The nine metadata columns with their defaults."""
    out = {}
    for name, default in META_DEFAULTS.items():
        kind = "boolean" if isinstance(default, bool) else "string"
        found = F.col(f"meta.{name}").cast(kind) if _has(rows, f"meta.{name}") else F.lit(None).cast(kind)
        out[name] = F.coalesce(found, F.lit(default))
    return out


def resolved_path(path: Column, base: str, present: Column | None = None, here: str = "") -> Column:
    """Absolute paths as they are; a path that is present in the working folder `here` is taken there; others lie below base."""
    found = F.when(path.startswith("/"), path)
    if present is not None:
        found = found.when(present, F.concat_ws("/", F.lit(here.rstrip("/")), path))
    return found.otherwise(F.concat_ws("/", F.lit(base.rstrip("/")), path))


def resolve_paths(rows: DataFrame, path: str, base: str, listing: DataFrame, here: str) -> DataFrame:
    """rows with `path` resolved; listing (path) holds the working folder's relative paths."""
    known = listing.select(F.col("path").alias(path)).distinct().withColumn("_present", F.lit(True))
    joined = rows.join(known, path, "left")
    return joined.withColumn(path, resolved_path(F.col(path), base, F.col("_present").isNotNull(), here)).drop("_present")


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row for each key: the last by position. max_by sums up before the shuffle, so a frequent key stays cheap."""
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), position).alias("_last"))
    return last.select(key, *(F.col(f"_last.{c}").alias(c) for c in others)).select(*rows.columns)


def align(annotations: DataFrame, results: DataFrame, key: str, position: str) -> DataFrame:
    """Left-driven: every annotation with the last result of its key; surplus results are left out."""
    return annotations.join(last_wins(results, key, position), key, "left")


def missing(annotations: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return annotations.select(key).distinct().join(results, key, "left_anti")


def align_strict(annotations: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """One to one: raises, while it runs, on a repeated key and on a key that one side lacks."""
    count = Window.partitionBy(key)

    def once(rows: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(count)
        marked = rows.withColumn(f"_{side}", F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{side}: duplicate key "), F.col(key).cast("string")))))
        return marked

    both = once(annotations, "annotations").join(once(predictions, "predictions"), key, "full")
    whole = F.col("_annotations") & F.col("_predictions")
    checked = both.withColumn("_whole", F.when(F.coalesce(whole, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("missing or extra key "), F.col(key).cast("string")))))
    return checked.filter("_whole").drop("_annotations", "_predictions", "_whole")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with `_n`, the 0-based rank by the key; ties are settled by a hash of the whole row, so only equal rows may change
    places. Spark's range partitioner cuts the order into even ranges, through a frequent key as well; the rows are written
    range by range, and a rank is the rows of the ranges before and the place within."""
    tie = F.xxhash64(*rows.columns)
    cut = rows.withColumn("_tie", tie).repartitionByRange(key, "_tie").withColumn("_range", F.spark_partition_id())
    held = materialise(cut, "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over the counts of the ranges
    bases = held.groupBy("_range").agg(F.count("*").alias("_c")).select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key, "_tie")) - 1
    return held.join(bases, "_range").withColumn("_n", (F.col("_base") + within).cast("long")).drop("_range", "_base", "_tie")


def positional(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The n-th row of one side with the n-th of the other, each side by its own numeric key."""
    return numbered(left, left_key).join(numbered(right, right_key), "_n").drop("_n")


def with_default(rows: DataFrame, dimension: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """Lookup with a default; `applied` says whether the dimension had the key."""
    found = dimension.select(key, F.col(value).alias("_value"))
    joined = rows.join(found, key, "left")
    return joined.withColumn("applied", F.col("_value").isNotNull()).withColumn(value, F.coalesce("_value", F.lit(default))).drop("_value")


def upsert(base: DataFrame, candidates: DataFrame, keys: list[str], evidence: list[str]) -> DataFrame:
    """Merge: a candidate that meets a base row fills its evidence columns and notes its own source in cluster_source; the
    base row keeps its source. Other candidates are appended."""
    b = base.select(*keys, F.col("source").alias("_base_source"))
    c = candidates.select(*keys, F.col("source").alias("_new_source"), *evidence)
    both = b.join(c, keys, "full")
    return both.select(
        *keys,
        F.coalesce("_base_source", "_new_source").alias("source"),
        F.when(F.col("_base_source").isNotNull(), F.col("_new_source")).alias("cluster_source"),
        *evidence,
    )


def suffix_pairs(names: DataFrame, name: str, value: str, suffix: str) -> DataFrame:
    """Pairs of values whose names differ by the suffix alone; a name's last value (the largest here) counts."""
    last = names.filter(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(name).agg(F.max(value).alias(value))
    longer = last.filter(F.col(name).endswith(suffix)).select(F.expr(f"left({name}, length({name}) - {len(suffix)})").alias(name), F.col(value).alias("_other"))
    pairs = last.join(longer, name).filter(F.col(value) != F.col("_other"))
    return pairs.select(F.least(value, "_other").alias("a"), F.greatest(value, "_other").alias("b"), F.lit("suffix").alias("source")).distinct()

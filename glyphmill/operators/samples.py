"""Sample rows of a training set: id, images, messages and meta, built from lines and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as t

EVENT = ("line_index", "position", "pair_id", "ordered_chars", "font_asset", "source", "context_variant")


def event_meta() -> Column:
    """An event's columns as the struct that a sample carries: both places of the pair in one array."""
    places = F.array(F.col("position").cast("long"), (F.col("position") + 1).cast("long"))
    return F.struct(F.col("line_index").cast("long").alias("line_index"), places.alias("positions"), "pair_id", "ordered_chars", "font_asset", "source", F.col("context_variant").cast("long").alias("context_variant"))


def sample_rows(samples: DataFrame, lines: DataFrame, events: DataFrame, key: str, split: str, prompt: str, symbols: str) -> DataFrame:
    """(id, images, messages, meta), one for each row of samples (key, script_class, granularity, eligible_lines).

    lines: (key, line_index, text); a sample's label are its lines in order, each ended by a line feed. events: (key, *EVENT),
    in order of line and place. A sample without lines has an empty label, one without events an empty array. The lines of a
    sample are one value, so one task holds them; samples are spread by key. Nulls among the texts count as empty lines.
    """
    said = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("line_index").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t")))).alias("_lines"))
    said = said.select(key, t.lines_to_target(F.transform("_lines", lambda x: x["t"])).alias("_label"))
    forced = events.groupBy(key).agg(F.sort_array(F.collect_list(event_meta())).alias("_events"))
    none = F.array().cast(forced.schema["_events"].dataType)
    both = samples.join(said, key, "left").join(forced, key, "left").withColumn("_events", F.coalesce("_events", none))
    number = F.lpad(F.col(key).cast("string"), 6, "0")
    count = t.count_of(F.col("_label"), symbols)
    made = both.withColumn("_label", F.coalesce("_label", F.lit("")))
    meta = F.struct(
        F.lit("synthetic").alias("source_kind"), "script_class", "granularity", (count > 0).alias("has_symbol"), count.cast("long").alias("symbol_count"), F.col("eligible_lines").cast("long").alias("confusable_eligible_lines"),
        (F.size("_events") > 0).alias("has_forced_confusable"), F.size("_events").cast("long").alias("forced_confusable_count"), F.col("_events").alias("confusable_events"),
    )
    return made.select(
        F.concat(F.lit(f"synth_{split}_"), number).alias("id"),
        F.array(F.concat(F.lit(f"images/{split}/"), "script_class", F.lit("/"), "granularity", F.lit("/"), number, F.lit(".png"))).alias("images"),
        F.array(F.struct(F.lit("user").alias("role"), F.lit(prompt).alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("_label").alias("content"))).alias("messages"),
        meta.alias("meta"),
    )

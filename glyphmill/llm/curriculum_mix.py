"""Mixing sources to target weights over time (operator 3), in DataFrame functions only.

A source's share of the mix follows a weight schedule w(t) = w * (1 + slope * (2t - 1)) over training time t in [0, 1].
Its integral is W(t) = w * ((1 - slope) * t + slope * t * t), with W(1) = w, so a source with target T has asked for
T * W(t) / w words by time t. Its documents stand in a fixed hashed order; the word at offset c is asked for at the time
where the demand reaches c: the inverse, a root of a quadratic, is the document's training position.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm._common import WORD, hashed_order

#: Weights of the sources in code point order, repeating; the mix's share of all words; the most copies of a document.
WEIGHTS, SHARE, COPIES = (5.0, 2.0, 1.0), 1.5, 2
#: Slopes of the sources' schedules in the same order, repeating: early, late, even. Between -1 and 1, so w(t) >= 0.
SLOPES = (-0.5, 0.75, 0.0)
#: The hashed order within a source is cut into 2^ORDER_BITS buckets, and each of these into as many parts as bring a part
#: to about PART_ROWS rows: running sums go over buckets, then over a bucket's parts, then within a part.
ORDER_BITS, PART_ROWS, HASH_BITS = 12, 4096, 60


def words(column: str = "text") -> F.Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(column), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def _pick(values: tuple[float, ...], place: F.Column) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (place % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame) -> DataFrame:
    """A row for each source: source, source_size, weight, slope, target, from the sizes of its documents or parts.

    With the sources sorted by cap / weight, the first ones are capped: those whose cap is at most the level that the rest
    would then share. Resharing the excess by weight until none is above its cap ends in the same level.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    named = sizes.withColumn("place", F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)
    named = named.withColumn("weight", _pick(WEIGHTS, F.col("place"))).withColumn("slope", _pick(SLOPES, F.col("place")))
    named = named.withColumn("cap", F.col("source_size").cast("double") * COPIES)
    by_level = every.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    named = (
        named.withColumn("total", F.sum("source_size").over(every).cast("double") * SHARE)
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    )
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(every)["level"]
    return named.withColumn("target", F.when(final.isNull(), F.col("cap")).otherwise(F.least("cap", final * F.col("weight")))).select("source", "source_size", "weight", "slope", "target")


def position(offset: F.Column, target: F.Column, slope: F.Column) -> F.Column:
    """The time at which the demand target * ((1 - slope) t + slope t^2) reaches offset."""
    share = F.least(F.lit(1.0), F.when(target > 0, offset / target).otherwise(F.lit(0.0)))
    flat = 1 - slope
    root = F.sqrt(F.greatest(F.lit(0.0), flat * flat + 4 * slope * share))
    return F.when(F.abs(slope) < 1e-12, share).otherwise(2 * share / (flat + root))


def _part_bits(rows: int) -> int:
    """Bits that cut a bucket into parts of about PART_ROWS rows each, were all rows of one source."""
    return min(HASH_BITS - ORDER_BITS, max(0, math.ceil(math.log2(max(1, rows) / PART_ROWS)) - ORDER_BITS))


def _bases(parts: DataFrame, fine: int) -> DataFrame:
    """_s, _b, base: the words of each source before each part of its hashed order. No window is over more than a source's
    2^ORDER_BITS buckets or a bucket's 2^fine parts."""
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    if not fine:
        return parts.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), base.alias("base"))
    whole = parts.groupBy("source", F.shiftright("bucket", fine).alias("bucket")).agg(F.sum("size").alias("size"))
    whole = whole.select(F.col("source").alias("_ws"), F.col("bucket").alias("_wb"), base.alias("_before"))
    inside = Window.partitionBy("source", F.shiftright("bucket", fine)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = parts.join(whole, parts["source"].eqNullSafe(whole["_ws"]) & (F.shiftright(parts["bucket"], fine) == whole["_wb"]))
    return joined.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), (F.col("_before") + F.col("base")).alias("base"))


def mix_plan(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken, start, slope, position.

    Null texts have size 0; null sources are a source of their own and come last; null doc_ids count as ''. Ties in the
    hashed order go to the smaller doc_id, then size; repeated rows are mixed one by one. An empty table gives an empty
    one; further columns are ignored; texts of any length are counted whole. The source's stream is its documents in order, repeated COPIES times; the mix takes
    the stream's first round(target) words, so a document's words are taken whole, up to COPIES times, but for the one
    where the target falls.
    """
    sized = docs.select("doc_id", "source", words().alias("size")).withColumn("u", hashed_order("doc_id"))
    fine = _part_bits(docs.count())
    # never null, as all know: a filter for it would tell apart the plans of the parts' words, which are counted once
    sized = sized.withColumn("bucket", F.coalesce(F.shiftright("u", HASH_BITS - ORDER_BITS - fine), F.lit(0).cast("long")))
    parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(parts).withColumnRenamed("source", "_source")
    buckets = _bases(parts, fine).join(targets, F.col("_s").eqNullSafe(targets["_source"])).drop("_source")
    placed = sized.join(buckets, sized["source"].eqNullSafe(buckets["_s"]) & (sized["bucket"] == buckets["_b"]))
    within = Window.partitionBy("_s", "_b").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    wanted = F.round("target").cast("long")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), wanted - F.col("start") - F.col("source_size") * copy)) for copy in range(COPIES)), F.lit(0))
    placed = placed.withColumn("taken", taken.cast("long"))
    return placed.withColumn("position", position(F.col("start").cast("double"), F.col("target"), F.col("slope"))).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "start", "slope", "position"
    )


def op3_curriculum_mix(docs: DataFrame) -> DataFrame:
    """The plan, range-sorted by training position."""
    plan = mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    return plan.orderBy("position", "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents in training order, columns as they came: a row for each copy that the mix takes, the last copy
    of a source cut after the words taken. n_chars, if there is such a column, follows the text.

    The plan is joined back by source, hash of doc_id and size; where several rows share all three, each takes the plan of one.
    """
    of = F.xxhash64("source", F.col("source").isNull())
    plan = mix_plan(docs).filter("taken > 0").withColumn("u", hashed_order("doc_id")).withColumn("of", of)
    nth = F.row_number().over(Window.partitionBy("u", "size", "of").orderBy("position"))
    named = ("u", "of", "size", "source_size", "target", "taken", "start", "slope")
    plan = plan.select(*(F.col(c).alias(f"__gm_{c}") for c in named), nth.alias("__gm_nth"))
    own = F.row_number().over(Window.partitionBy("__gm_key", "__gm_words", "__gm_from").orderBy(F.xxhash64("text")))
    numbered = docs.withColumn("__gm_words", words()).filter("__gm_words > 0").withColumn("__gm_key", hashed_order("doc_id")).withColumn("__gm_from", of).withColumn("__gm_own", own)
    # the last term isn't a join key on purpose: the window's partitioning then serves the join, and the texts move once
    same = (F.col("__gm_key") == F.col("__gm_u")) & (F.col("__gm_words") == F.col("__gm_size")) & (F.col("__gm_from") == F.col("__gm_of")) & (F.col("__gm_own") - F.col("__gm_nth") == 0)
    joined = numbered.join(plan, same)
    size = F.col("__gm_size")
    copies = F.transform(
        F.sequence(F.lit(0), F.lit(COPIES - 1)),
        lambda k: F.struct(
            F.greatest(F.lit(0), F.least(size, F.col("__gm_taken") - size * k)).cast("long").alias("words"),
            position((F.col("__gm_start") + F.col("__gm_source_size") * k).cast("double"), F.col("__gm_target"), F.col("__gm_slope")).alias("at"),
        ),
    )
    dealt = joined.withColumn("__gm_copy", F.explode(F.filter(copies, lambda c: c["words"] > 0)))
    first_words = F.slice(F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*+" + WORD + "+"), F.lit(0)), F.lit(1), F.col("__gm_copy.words").cast("int"))
    text = F.when(F.col("__gm_copy.words") >= size, F.col("text")).otherwise(F.array_join(first_words, ""))
    dealt = dealt.withColumn("text", text).orderBy("__gm_copy.at", "doc_id")
    if "n_chars" in docs.columns:
        dealt = dealt.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return dealt.select(*docs.columns)


#: The plan's contract columns and position, in DuckDB's SQL.
SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM sizes),
named AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][place % 3 + 1] AS weight, [-0.5::DOUBLE, 0.75, 0.0][place % 3 + 1] AS slope, 2.0::DOUBLE * source_size AS cap FROM placed),
level AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lv
  FROM named WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(lv, cap / weight) AS lv FROM level WHERE cap > lv * weight),
targets AS (
  SELECT l.source, l.source_size, l.slope, CASE WHEN f.lv IS NULL THEN l.cap ELSE least(l.cap, f.lv * l.weight) END AS target
  FROM level l CROSS JOIN final f),
starts AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slope,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, greatest(0, least(size, round(target)::BIGINT - start)) + greatest(0, least(size, round(target)::BIGINT - start - source_size)) AS taken,
         least(1.0, CASE WHEN target > 0 THEN start / target ELSE 0.0 END) AS share FROM starts)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN abs(slope) < 1e-12 THEN share ELSE 2 * share / ((1 - slope) + sqrt(greatest(0.0, (1 - slope) * (1 - slope) + 4 * slope * share))) END AS position
FROM mixed
"""

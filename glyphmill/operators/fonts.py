"""Fonts as tables of code point segments: coverage, the choice of a font for each character, and sizes at which text fits."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.numeric import hashed_pick

# The ranges whose characters have fonts of their own, and the fallback; the smallest size that is tried and
# the tracking in hundredths of the size.
CIRCLED, YI = (0x2460, 0x2473), (0xA000, 0xA4CF)
LEAST_SIZE, TRACKING = 10, 6
#: Code points of one bucket of the interval join.
BUCKET = 256


def code_points(texts: DataFrame, text: str) -> DataFrame:
    """(codepoint): the different code points of all texts, 1,114,112 at most. A text sends each of its characters once."""
    return texts.select(F.explode(F.array_distinct(F.split(text, ""))).alias("_c")).filter("_c <> ''").distinct().select(F.ascii("_c").alias("codepoint"))


def covering_fonts(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(codepoint, kind, fonts): for each kind of font that covers a code point, the covering fonts in order.

    segments: (kind, font, first, last), ends included; they may overlap. An interval join on buckets of code points: a
    segment goes to the buckets that it touches, a code point to its own, so neither side meets all of the other.
    """
    cut = segments.filter("first <= last").withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / BUCKET), F.floor(F.col("last") / BUCKET))))
    met = points.withColumn("_b", F.floor(F.col("codepoint") / BUCKET)).join(cut, "_b").filter("codepoint between first and last")
    return met.groupBy("codepoint", "kind").agg(F.array_sort(F.collect_set("font")).alias("fonts"))


def coverage(texts: DataFrame, key: str, text: str, segments: DataFrame) -> DataFrame:
    """(key, n_chars, n_uncovered, n_fonts): a text's different characters, those that no segment covers, and the fonts that
    cover any of them. Empty and null texts have none."""
    chars = texts.select(key, F.explode_outer(F.array_distinct(F.split(text, ""))).alias("_c")).withColumn("codepoint", F.when(F.col("_c") != "", F.ascii("_c")))
    found = covering_fonts(code_points(texts, text), segments).groupBy("codepoint").agg(F.flatten(F.collect_list(F.transform("fonts", lambda f: F.struct("kind", f.alias("font"))))).alias("_fonts"))
    known = chars.join(found, "codepoint", "left").withColumn("_n", F.size(F.coalesce("_fonts", F.array().cast(found.schema["_fonts"].dataType))))
    counted = known.groupBy(key).agg(F.count("codepoint").alias("n_chars"), F.count(F.when(F.col("codepoint").isNotNull() & (F.col("_n") == 0), 1)).alias("n_uncovered"))
    used = known.select(key, F.explode("_fonts").alias("_f")).groupBy(key).agg(F.count_distinct("_f").alias("_used"))
    return counted.join(used, key, "left").select(key, "n_chars", "n_uncovered", F.coalesce("_used", F.lit(0)).cast("long").alias("n_fonts"))


def chosen_fonts(chars: DataFrame, segments: DataFrame, seed: int) -> DataFrame:
    """chars (key, position, char, forced) with kind, font and problem.

    Circled digits take a circled font only; Yi characters a Yi font, or a fallback (cjk) font where none covers them; all
    others a fallback font. Among the covering fonts chance decides, a hash of seed, key and position. A forced font is
    taken as it is: of the circled kind for circled digits, of the Yi kind otherwise. A problem is `uncovered` where no font
    of the kind covers the character, and `forced font lacks it`; font is null then. Each character's fonts are looked up
    once for all its occurrences.
    """
    points = chars.select(F.ascii("char").alias("codepoint")).distinct()
    found = covering_fonts(points, segments).groupBy("codepoint").agg(F.map_from_entries(F.collect_list(F.struct("kind", "fonts"))).alias("_kinds"))
    met = chars.withColumn("codepoint", F.ascii("char")).join(found, "codepoint", "left")
    point, of = F.col("codepoint"), lambda kind: F.try_element_at("_kinds", F.lit(kind))
    own = F.when(point.between(*CIRCLED), "circled").when(F.col("forced").isNotNull() | point.between(*YI) & of("yi").isNotNull(), "yi").otherwise("cjk")
    met = met.withColumn("kind", own)
    fonts = F.try_element_at("_kinds", F.col("kind"))
    picked = F.get(fonts, hashed_pick(F.size(fonts), seed, F.col("key"), F.col("position")))
    forced = F.when(F.array_contains(fonts, F.col("forced")), F.col("forced"))
    font = F.when(F.col("forced").isNotNull(), forced).otherwise(picked)
    problem = F.when(font.isNotNull(), None).when(F.col("forced").isNotNull(), "forced font lacks it").otherwise("uncovered")
    return met.select("key", "position", "char", "kind", font.alias("font"), problem.alias("problem"))


def fitting_size(text: Column, max_width: Column, requested: Column, widths: Mapping[int, str], other: int = 1000, tracking: int = TRACKING, least: int = LEAST_SIZE) -> Column:
    """The largest size from `requested` down to `least` at which the text is max_width wide at most, null if there is none.

    widths: thousandths of the size to the characters of that width, `other` for the rest. At a size a character takes its
    width rounded to a whole unit, and tracking hundredths of the size. Wider with every size, so the size is found by
    bisection: a text is read once for each width, not once for each size. Null texts are empty.
    """
    text = F.coalesce(text, F.lit(""))
    n = F.length(text).cast("long")
    counts = {units: n - F.length(F.translate(text, chars, "")) for units, chars in widths.items()}
    counts[other] = counts.get(other, F.lit(0).cast("long")) + n - reduce(lambda a, b: a + b, list(counts.values()), F.lit(0).cast("long"))
    held = F.array(*(F.struct(F.lit(u).cast("long").alias("units"), c.alias("n")) for u, c in counts.items()))

    def wide(found: Column, size: Column) -> Column:
        return F.aggregate(found, F.lit(0).cast("long"), lambda s, g: s + g["n"] * (100 * F.floor((g["units"] * size + 500) / 1000) + tracking * size))

    def searched(found: Column) -> Column:
        limit = max_width.cast("long") * 100
        # low fits (or is one below the least size), high doesn't (or is one above the requested one)
        start = F.struct(F.lit(least - 1).cast("long").alias("low"), (requested.cast("long") + 1).alias("high"))

        def halved(s: Column, _: Column) -> Column:
            middle = F.floor((s["low"] + s["high"]) / 2)
            fits = wide(found, middle) <= limit
            return F.when(s["high"] - s["low"] <= 1, s).otherwise(F.struct(F.when(fits, middle).otherwise(s["low"]).alias("low"), F.when(fits, s["high"]).otherwise(middle).alias("high")))

        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(requested, F.lit(least)) + 2)).cast("int"))
        found_size = F.aggregate(steps, start, halved)["low"]
        return F.when(found_size >= least, found_size)

    return F.get(F.transform(F.array(held), searched), F.lit(0))

"""Exact quotas, deterministic sampling and closed-form schedules for synthetic data.

Chance is a hash of a seed, the row's key and a stage, so a row's draw depends on nothing else. Tables that are ordered as
a whole here are plans of a stated size, never data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import hashed_lines
from glyphmill.functions import text as t
from glyphmill.functions.numeric import hashed_pick, hashed_uniform, largest_remainder

# Ranges, weights, marks and profiles that the planned data sets are defined by.
GRANULARITY = {"line": ((1, 1), (4, 14)), "region": ((3, 8), (4, 16)), "page": ((15, 34), (4, 20))}
FAMILY_WEIGHTS = {
    "line_anchor": 0.22,
    "region_anchor": 0.22,
    "single_column_anchor": 0.22,
    "stacked_interleaved_a": 0.22,
    "two_column_flow": 0.06,
    "aligned_bilingual_rows": 0.03,
    "independent_spatial_columns": 0.03,
}
MIXED_ONLY = ("stacked_interleaved_a", "aligned_bilingual_rows", "independent_spatial_columns")
PAUSE, PAUSE_SHARES = "，、；：", (0.70, 0.20, 0.05, 0.05)
END, END_SHARES = "。？！", (0.80, 0.10, 0.10)
QUOTES = (("“", "”"), ("‘", "’"), ("（", "）"), ("《", "》"))
INLINE = ("——", "…", "·")
DECORATIONS, DECORATION_SHARES = ("pause", "end", "quote", "inline", "digits"), (0.55, 0.25, 0.08, 0.05, 0.07)
CIRCLED_FIRST, CIRCLED_COUNT = 0x2460, 20
POSITIONS = ("line_start", "line_middle", "line_end")
GEOMETRY = {
    "train_balanced": ((980, 1280), (0.05, 0.105), (0.035, 0.085)),
    "train_wide": ((1280, 1500), (0.06, 0.125), (0.025, 0.07)),
    "train_compact": ((900, 1080), (0.04, 0.08), (0.055, 0.10)),
    "dev_narrow_wide_gutter": ((820, 900), (0.025, 0.04), (0.115, 0.155)),
    "dev_wide_large_margin": ((1520, 1680), (0.145, 0.18), (0.018, 0.032)),
}
TEMPLATE_WEIGHTS = {"general_word_shape": 0.65, "name_shape": 0.15, "year_number": 0.10, "abbreviation_code": 0.10}
ENVIRONMENT_WEIGHTS = {"pure_latin": 0.20, "yi_latin": 0.40, "yi_han_latin": 0.40}
ADDON_GRANULARITY_WEIGHTS = {"line": 0.40, "region": 0.60}
RESIDUAL_TYPES = ("external_residual", "true_glyph_degradation")
CONDITIONS, FONT_SIZES, PAIR_STRIDE = ("clear", "mild_old_print"), (20, 24, 28, 32), 271
DEGRADATIONS = ("geometry", "ink", "blur", "resample", "jpeg")


def _choice(values: Sequence[str], shares: Sequence[float], u: Column) -> Column:
    bounds = [sum(shares[: i + 1]) for i in range(len(values) - 1)]
    return reduce(lambda c, vb: c.when(u < vb[1], vb[0]), list(zip(values, bounds, strict=False)), F.when(F.lit(False), "")).otherwise(values[-1])


def hashed_int(low: Column | int, high: Column | int, *keys: Column | str | int) -> Column:
    """A whole number from low to high, both included."""
    low = low if isinstance(low, Column) else F.lit(low)
    return (low + F.floor(hashed_uniform(*keys) * (F.lit(high) - low + 1 if not isinstance(high, Column) else high - low + 1))).cast("int")


def weights_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(i, k, float(w)) for i, (k, w) in enumerate(weights.items())], "ord int, value string, weight double")


def permuted(rows: DataFrame, seed: int, *keys: str, name: str = "place", bits: int = 12) -> DataFrame:
    """rows with a 1-based place in an order shuffled by seed and keys; ties by the keys.

    A place is the number of rows in the hash buckets before, and the rank within the bucket: a window over the counts of
    2^bits buckets and one over each bucket, never over all rows.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *(F.col(k).cast("string") for k in keys)).cast("binary"))
    dealt = rows.withColumn("_order", order).withColumn("_bucket", F.shiftright(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), 32 - bits))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over 2^bits counts
    bases = dealt.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_order", *keys))
    return dealt.join(F.broadcast(bases), "_bucket").withColumn(name, F.col("_base") + within).drop("_order", "_bucket", "_base")


def exact_values(spark: SparkSession, weights: dict[str, float], total: int, seed: int) -> DataFrame:
    """(place, value): each value exactly its quota's number of times, shuffled."""
    quotas = largest_remainder(weights_table(spark, weights), total)
    copies = quotas.filter("quota > 0").select("value", "ord", F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("copy"))
    return permuted(copies, seed, "ord", "copy").select("place", "value")


def sample_plan(spark: SparkSession, total: int, ratio: dict[str, float], split: str, seed: int, families: dict[str, float] | None = None) -> DataFrame:
    """(place, plan_index, script_class, granularity, family, profile): families by quota, script classes by quota within
    each but for the mixed-only ones; every fifth row of a stratum of the dev split is clear print."""
    quotas = largest_remainder(weights_table(spark, families or FAMILY_WEIGHTS), total).select(F.col("ord").alias("family_ord"), F.col("value").alias("family"), F.col("quota").alias("family_quota"))
    classes = weights_table(spark, ratio).select(F.col("ord").alias("class_ord"), F.col("value").alias("script_class"), "weight")
    only = F.col("family").isin(*MIXED_ONLY)
    mixed = quotas.filter(only).select("*", F.lit(0).alias("class_ord"), F.lit("mixed").alias("script_class"), F.lit(1.0).alias("weight"))
    strata = quotas.filter(~only).join(F.broadcast(classes)).unionByName(mixed)  # families times classes, both fixed
    within = Window.partitionBy("family")
    share = F.col("weight") / F.sum("weight").over(within) * F.col("family_quota")
    strata = strata.withColumn("share", share).withColumn("floor", F.floor("share"))
    left = F.col("family_quota") - F.sum("floor").over(within)
    rank = F.row_number().over(within.orderBy(F.desc(F.col("share") - F.col("floor")), "class_ord"))
    strata = strata.withColumn("n", (F.col("floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).filter("n > 0")
    before = Window.partitionBy(F.lit(0)).orderBy("family_ord", "class_ord").rowsBetween(Window.unboundedPreceding, -1)  # over the strata
    granularity = F.when(F.col("family").isin("line_anchor", "region_anchor"), F.replace(F.col("family"), F.lit("_anchor"), F.lit(""))).otherwise(F.lit("page"))
    runs = strata.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("granularity", granularity)
    plan = runs.select((F.explode(F.sequence("first", F.col("first") + F.col("n") - 1))).alias("plan_index"), "script_class", "granularity", "family")
    tagged = every_nth(plan, ["granularity", "family"], "plan_index", 5, "clear") if split == "dev" else plan.withColumn("clear", F.lit(False))
    return permuted(tagged.withColumn("profile", F.when(F.col("clear"), "clear_print").otherwise("standard")).drop("clear"), seed, "plan_index")


def every_nth(rows: DataFrame, strata: list[str], order: str, n: int, name: str) -> DataFrame:
    """Marks the first and then every n-th row of a stratum."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*strata).orderBy(order)) - 1) % n == 0)


def round_robin(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """rows with the shard that dealing them out in order gives. The order must be dense (0, 1, 2 ...)."""
    return rows.withColumn("shard", F.pmod(F.col(order), F.lit(shards)).cast("int"))


# -- text ----------------------------------------------------------------------------------------------------------


def picked(pool: str | Column, length: Column, *keys: Column | str | int) -> Column:
    """`length` characters of the pool, each picked by hash."""
    chars = pool if isinstance(pool, Column) else F.lit(pool)
    return F.when(length > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: F.substring(chars, hashed_pick(F.length(chars), *keys, i) + 1, F.lit(1))), "")).otherwise("")


def sampled_line(script_class: Column, length: Column, first: str, second: str, share: float, *keys: Column | str | int) -> Column:
    """A line of one pool, or, for mixed rows, runs of up to four characters that are of the first pool with the given
    share: a character's run is the hash of its place div 4's draw."""
    texts = [(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys]
    return hashed_lines.sampled_line(script_class, length, first, second, share, F.concat_ws(":", *texts, F.lit("")))


def decorated(line: Column, rate: float, *keys: Column | str | int) -> Column:
    """The line with, at the given rate, one mark: a pause, an end, quotes, an inline symbol, or digits."""
    place = F.when(F.length(line) > 1, hashed_int(1, F.length(line) - 1, *keys, "at")).otherwise(F.length(line))
    kind = _choice(DECORATIONS, DECORATION_SHARES, hashed_uniform(*keys, "kind"))
    quote = F.element_at(F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in QUOTES)), hashed_pick(len(QUOTES), *keys, "quote") + 1)
    inline = F.element_at(F.array(*map(F.lit, INLINE)), hashed_pick(len(INLINE), *keys, "inline") + 1)
    made = (
        F.when(kind == "pause", t.splice(line, place, _choice(PAUSE, PAUSE_SHARES, hashed_uniform(*keys, "pause"))))
        .when(kind == "end", F.concat(line, _choice(END, END_SHARES, hashed_uniform(*keys, "end"))))
        .when(kind == "quote", F.concat(quote[0], line, quote[1]))
        .when(kind == "inline", t.splice(line, place, inline))
        .otherwise(t.splice(line, place, picked("0123456789", hashed_int(1, 3, *keys, "digits"), *keys, "digit")))
    )
    return F.when((line == "") | (hashed_uniform(*keys, "rate") >= rate), line).otherwise(made)


def sampled_lines(plan: DataFrame, first: str, second: str, share: float, rate: float, seed: int) -> DataFrame:
    """plan (plan_index, script_class, granularity) -> (plan_index, line_index, text): each row's number of lines and their
    lengths by its granularity's ranges."""
    spans = F.create_map(*(x for g, (a, b) in GRANULARITY.items() for x in (F.lit(g), F.array(*map(F.lit, (*a, *b))))))
    span = F.element_at(spans, F.col("granularity"))
    key = F.col("plan_index")
    lined = plan.withColumn("_s", span).withColumn("_n", hashed_int(F.col("_s")[0], F.col("_s")[1], seed, key, "lines"))
    exploded = lined.withColumn("line_index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    length = hashed_int(F.col("_s")[2], F.col("_s")[3], seed, key, "length", F.col("line_index"))
    raw = exploded.withColumn("_l", sampled_line(F.col("script_class"), length, first, second, share, seed, key, F.col("line_index")))
    return raw.withColumn("text", decorated(F.col("_l"), rate, seed, key, F.col("line_index"), "mark")).drop("_s", "_n", "_l")


def canvas_geometry(rows: DataFrame, profile: str, key: str, seed: int) -> DataFrame:
    """rows with canvas_width, margin, gutter, base_size, line_step drawn from the profile's ranges."""
    table = F.create_map(*(x for p, (w, m, g) in GEOMETRY.items() for x in (F.lit(p), F.array(*(F.lit(float(v)) for v in (*w, *m, *g))))))
    g, k = F.element_at(table, F.col(profile)), F.col(key)
    made = rows.withColumn("_g", g).withColumn("canvas_width", hashed_int(F.col("_g")[0].cast("int"), F.col("_g")[1].cast("int"), seed, k, "width"))

    def ratio(low: int, name: str) -> Column:
        return F.col("_g")[low] + hashed_uniform(seed, k, name) * (F.col("_g")[low + 1] - F.col("_g")[low])

    made = made.withColumn("margin", F.floor(F.col("canvas_width") * ratio(2, "margin")).cast("int")).withColumn("gutter", F.floor(F.col("canvas_width") * ratio(4, "gutter")).cast("int"))
    made = made.withColumn("base_size", hashed_int(27, 36, seed, k, "size"))
    return made.withColumn("line_step", F.floor(F.col("base_size") * (1.45 + 0.30 * hashed_uniform(seed, k, "step"))).cast("int")).drop("_g")


def page_blocks(lines: DataFrame, page: str, width: str, margin: str, gutter: str, step: str) -> DataFrame:
    """Positioned blocks of page lines by layout family: one column, two columns read row by row, pairs stacked or aligned,
    or columns that run independently. The label comes from the coordinates alone (layout.visual_rows)."""
    index, family = F.col("line_index"), F.col("family")
    half = ((F.col(width) - 2 * F.col(margin) - F.col(gutter)) / 2).cast("int")
    right = F.col(margin) + half + F.col(gutter)
    two = family.isin("two_column_flow", "aligned_bilingual_rows", "independent_spatial_columns")
    side = F.when(family == "two_column_flow", index % 2).when(two, index % 2).otherwise(F.lit(0))
    row = F.when(two, F.floor(index / 2)).otherwise(index)
    shift = F.when((family == "independent_spatial_columns") & (side == 1), F.floor(F.col(step) / 2)).otherwise(F.lit(0))
    return lines.select(
        page,
        index.cast("long").alias("id"),
        "text",
        F.when(side == 0, F.col(margin)).otherwise(right).cast("int").alias("x"),
        (F.col(margin) + row * F.col(step) + shift).cast("int").alias("y"),
        F.when(two, half).otherwise(F.col(width) - 2 * F.col(margin)).cast("int").alias("w"),
        (F.col(step) * 0.7).cast("int").alias("h"),
        family.alias("role"),
    )


# -- schedules -----------------------------------------------------------------------------------------------------


def pair_schedule(events: DataFrame, cursor: str, pairs: int, repeats: int, fonts: int, order: DataFrame | None = None) -> DataFrame:
    """events with pair, font, swapped and context_variant in closed form of the 0-based cursor: each pair `repeats` times in
    a row, its fonts in turn; the characters are swapped where pair + font is odd. order: (ordered, pair), a permutation."""
    if repeats != 1 and repeats % fonts:
        raise ValueError("repeats must be one or a multiple of the fonts")
    ordered = F.floor(F.col(cursor) / repeats).cast("long")
    turn = F.col(cursor) % repeats
    made = events.withColumn("ordered", ordered).filter(F.col("ordered") < pairs)
    made = made.withColumn("font", ((turn if repeats > 1 else F.col("ordered")) % fonts).cast("int")).withColumn("context_variant", F.floor(turn / fonts).cast("int"))
    made = made.join(order, "ordered") if order is not None else made.withColumn("pair", F.col("ordered"))
    return made.withColumn("swapped", (F.col("pair") + F.col("font")) % 2 == 1)


def injection_lanes(lines: DataFrame, characters: str) -> DataFrame:
    """The lines with two neighbours of the class, with their `places` and `lane`: anchor (of line and region rows), or, where
    there is a layout_family, single_page and complex_page. Of a complex page only the first such line counts."""
    found = lines.withColumn("places", t.adjacent_positions(F.col("text"), characters)).filter(F.size("places") > 0)
    anchors = found.filter(F.col("granularity").isin("line", "region")).withColumn("lane", F.lit("anchor"))
    if "layout_family" not in lines.columns:
        return anchors
    pages = found.filter(~F.col("granularity").isin("line", "region"))
    single = pages.filter("layout_family = 'single_column_anchor'").withColumn("lane", F.lit("single_page"))
    first = F.row_number().over(Window.partitionBy("row_id").orderBy("line_index"))
    complex_pages = pages.filter("layout_family <> 'single_column_anchor'").withColumn("_n", first).filter("_n = 1").drop("_n").withColumn("lane", F.lit("complex_page"))
    return anchors.unionByName(single).unionByName(complex_pages)


def inject_pairs(lines: DataFrame, bank: DataFrame, characters: str, repeats: int, fonts: int, seed: int, complex_share: float = 0.0) -> DataFrame:
    """lines (line_id, granularity, text) -> the lines that get an event, with lane, pair, place and the new text.

    Anchor lines are shuffled and the first pairs * repeats taken, but for the share of the events that goes to complex pages
    (one event a page; needs row_id, line_index and layout_family). A hashed one of a line's places is overwritten by the
    scheduled pair. bank: (pair, a, b), a bounded bank.
    """
    total = bank.count()
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("line_id").cast("string")).cast("binary"))
    lanes = injection_lanes(lines, characters).withColumn("_o", order)
    anchors, pages, on_pages = lanes.filter("lane = 'anchor'"), lanes.filter("lane = 'complex_page'"), 0
    chosen = total * repeats
    if complex_share:
        have = {r["lane"]: r["count"] for r in lanes.groupBy("lane").count().collect()}  # three lanes
        chosen = min(chosen, have.get("anchor", 0))
        on_pages = min(have.get("complex_page", 0), round(chosen * complex_share))
    taken = anchors.orderBy("_o", "line_id").limit(chosen - on_pages)
    if on_pages:
        taken = taken.unionByName(pages.orderBy("_o", "line_id").limit(on_pages))
    numbered = taken.withColumn("cursor", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lane", "_o", "line_id")) - 1)
    order = permuted(bank.select("pair"), seed, "pair").select((F.col("place") - 1).cast("long").alias("ordered"), "pair")
    planned = pair_schedule(numbered, "cursor", total, repeats, fonts, order).join(bank, "pair")
    place = F.element_at("places", hashed_pick(F.size("places"), seed, F.col("line_id"), "place") + 1)
    piece = F.when(F.col("swapped"), F.concat("b", "a")).otherwise(F.concat("a", "b"))
    made = planned.withColumn("position", place).withColumn("text", t.splice(F.col("text"), F.col("position"), piece, 2))
    return made.select("line_id", "lane", "cursor", "pair", "font", "context_variant", "swapped", "position", "text")


def injection_counters(lanes: DataFrame, injected: DataFrame, target: int) -> DataFrame:
    """One row: eligible lines, target, events, events on complex pages, and whether the target is reached (0 or 1)."""
    eligible = lanes.select(F.lit(1).alias("e"), F.lit(0).alias("o"), F.lit(0).alias("c"))
    events = injected.select(F.lit(0).alias("e"), F.lit(1).alias("o"), (F.col("lane") == "complex_page").cast("int").alias("c"))
    total = [F.coalesce(F.sum(c), F.lit(0)) for c in "eoc"]
    return eligible.union(events).agg(
        total[0].alias("eligible_lines"),
        F.lit(target).cast("long").alias("target_occurrences"),
        total[1].alias("pair_occurrences"),
        total[2].alias("complex_page_occurrences"),
        (total[1] == target).cast("int").alias("full_target_reached"),
    )


def circled_repeats(split: str, rows: int) -> int:
    """How often each marker occurs: 20 or 3 in the two formal sizes, else 3, 1 or 0 by size."""
    if (split, rows) == ("train", 18_000):
        return 20
    return 3 if (split, rows) == ("dev", 800) or rows >= 60 else 1 if rows >= CIRCLED_COUNT else 0


def circled_schedule(spark: SparkSession, repeats: int) -> DataFrame:
    """(marker, codepoint, font, position_kind, copy): every marker `repeats` times; with 20 the fonts occur 7, 7, 6 times,
    the 6 moving with the marker, and the positions likewise one ahead; with fewer each copy moves on by one."""
    base = spark.range(CIRCLED_COUNT).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max(0, repeats - 1))))).filter(F.lit(repeats > 0))

    def spread(short: Column) -> Column:
        """Of 20 copies, 7 for each of three values but 6 for `short`."""
        first = F.lit(7) - (short == 0).cast("int")
        second = first + F.lit(7) - (short == 1).cast("int")
        return F.when(F.col("copy") < first, 0).when(F.col("copy") < second, 1).otherwise(2)

    m = F.col("id")
    font = spread(m % 3) if repeats == 20 else (F.col("copy") if repeats == 3 else m % 3)
    position = spread((m + 1) % 3) if repeats == 20 else (m + F.col("copy")) % 3
    made = base.withColumn("marker", F.decode(F.unhex(F.lpad(F.hex(m + CIRCLED_FIRST), 4, "0")), "UTF-16BE"))
    return made.select("marker", t.code_point(F.col("marker")).alias("codepoint"), font.cast("int").alias("font"), F.element_at(F.array(*map(F.lit, POSITIONS)), position.cast("int") + 1).alias("position_kind"), F.col("copy").cast("int"))


def inject_circled(lines: DataFrame, schedule: DataFrame, seed: int) -> DataFrame:
    """lines (line_id, granularity, script_class, text), one for each row, with the scheduled markers put in: one event a
    row, at the start, inside or at the end; rows of the first script alone, and pages, get none."""
    eligible = lines.filter(F.col("granularity").isin("line", "region") & (F.col("script_class") != "pure_yi") & (F.col("text") != ""))
    n = schedule.count()
    rows = eligible.withColumn("_o", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("line_id").cast("string")).cast("binary"))).orderBy("_o", "line_id").limit(n)
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_o", "line_id"))).drop("_o")
    events = permuted(schedule, seed, "marker", "copy")
    both = numbered.join(events, "place")
    inside = F.when(F.length("text") > 1, hashed_int(1, F.length("text") - 1, seed, F.col("line_id"), "inside")).otherwise(F.length("text"))
    at = F.when(F.col("position_kind") == POSITIONS[0], 0).when(F.col("position_kind") == POSITIONS[2], F.length("text")).otherwise(inside)
    return both.withColumn("position", at).withColumn("text", t.splice(F.col("text"), F.col("position"), F.col("marker")))


def context_schedule(pages: DataFrame, page: str, pairs: int, fonts: int = 4, stride: int = PAIR_STRIDE) -> DataFrame:
    """pages x slots: a page shows one pair in each slot; slot s has font s div 2, condition s mod 2, and the pair s strides on."""
    slots = fonts * len(CONDITIONS)
    made = pages.select(page).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    font, condition = F.floor(F.col("slot") / len(CONDITIONS)).cast("int"), F.col("slot") % len(CONDITIONS)
    pair = F.pmod(F.col(page) + F.col("slot") * stride, F.lit(pairs)).cast("long")
    size = F.element_at(F.array(*map(F.lit, FONT_SIZES)), ((pair + font + condition) % len(FONT_SIZES)).cast("int") + 1)
    return made.select(page, "slot", font.alias("font"), F.element_at(F.array(*map(F.lit, CONDITIONS)), condition + 1).alias("condition"), pair.alias("pair"), size.alias("font_size"))


def context_lines(schedule: DataFrame, bank: DataFrame, pool: str, seed: int) -> DataFrame:
    """The schedule's two variants: 12 to 20 characters of the pool without the pair's own, the pair's a or b at a place that
    is four or more from either end. bank: (pair, a, b)."""
    both = schedule.join(bank, "pair")
    length, keys = hashed_int(12, 20, seed, F.col("pair"), F.col("slot"), "length"), (seed, F.col("pair"), F.col("slot"))
    made = both.withColumn("_n", length).withColumn("target_position", hashed_int(4, F.col("_n") - 5, *keys, "place"))
    clean = F.replace(F.replace(F.lit(pool), F.col("a"), F.lit("")), F.col("b"), F.lit(""))
    made = made.withColumn("_c", picked(clean, F.col("_n") - 1, *keys, "context"))
    return made.withColumn("a_text", t.splice(F.col("_c"), F.col("target_position"), F.col("a"))).withColumn("b_text", t.splice(F.col("_c"), F.col("target_position"), F.col("b"))).drop("_n", "_c")


def latin_plan(spark: SparkSession, total: int, seed: int) -> DataFrame:
    """(place, template, environment, granularity, lower_anchor, upper_anchors): exact quotas of all three; the first 26 word
    rows carry a to z, and name and code rows share out A to Z in turn."""
    if total < 52:
        raise ValueError("52 rows at least are needed to cover the alphabet")
    plan = exact_values(spark, TEMPLATE_WEIGHTS, total, seed).withColumnRenamed("value", "template")
    for i, (name, weights) in enumerate((("environment", ENVIRONMENT_WEIGHTS), ("granularity", ADDON_GRANULARITY_WEIGHTS)), 1):
        plan = plan.join(exact_values(spark, weights, total, seed + i).withColumnRenamed("value", name), "place")
    kind = F.when(F.col("template") == "general_word_shape", 1).when(F.col("template").isin("name_shape", "abbreviation_code"), 2).otherwise(0)
    own = Window.partitionBy("_k")
    ranked = plan.withColumn("_k", kind).withColumn("_r", F.row_number().over(own.orderBy("place")) - 1).withColumn("_m", F.count("*").over(own))
    lower = F.when((F.col("_k") == 1) & (F.col("_r") < 26), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.col("_r") + 1, F.lit(1)))
    upper = F.when(F.col("_k") == 2, F.array_join(F.filter(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.when(i % F.col("_m") == F.col("_r"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i + 1, F.lit(1)))), lambda c: c.isNotNull()), ""))
    return ranked.withColumn("lower_anchor", lower).withColumn("upper_anchors", upper).drop("_k", "_r", "_m")


def latin_texts(plan: DataFrame, first: str, second: str, seed: int) -> DataFrame:
    """The plan with a text for each row: the template's Latin piece, beside runs of the environment's scripts in hashed order."""
    k, low = (seed, F.col("place")), "abcdefghijklmnopqrstuvwxyz"
    word = F.concat(F.coalesce("lower_anchor", picked(low, F.lit(1), *k, "first")), picked(low, hashed_int(2, 8, *k, "len"), *k, "word"))
    capitals = F.when(F.coalesce(F.length("upper_anchors"), F.lit(0)) > 0, F.col("upper_anchors")).otherwise(picked(low.upper(), hashed_int(2, 5, *k, "caps"), *k, "cap"))
    names = F.array_join(F.transform(F.split(capitals, ""), lambda c: F.concat(c, picked(low, hashed_int(3, 9, *k, "name", c), *k, "letters", c))), " ")
    year = F.concat(F.lit("No."), hashed_int(1, 499, *k, "no").cast("string"), F.lit(" ("), hashed_int(1900, 2100, *k, "year").cast("string"), F.lit(")"))
    code = F.concat(capitals, F.lit("-"), hashed_int(1, 99, *k, "code").cast("string"))
    latin = F.when(F.col("template") == "general_word_shape", word).when(F.col("template") == "name_shape", names).when(F.col("template") == "year_number", year).otherwise(code)
    a, b = picked(first, hashed_int(3, 9, *k, "ya"), *k, "yc"), picked(second, hashed_int(3, 8, *k, "ha"), *k, "hc")
    runs = F.when(F.col("environment") == "pure_latin", F.array(latin)).when(F.col("environment") == "yi_latin", F.array(a, latin)).otherwise(F.array(a, b, latin))
    shuffled = F.transform(F.array_sort(F.transform(runs, lambda r, i: F.struct(hashed_uniform(*k, "order", i).alias("o"), r.alias("r")))), lambda s: s["r"])
    return plan.withColumn("text", F.concat(F.array_join(shuffled, ""), F.lit("\n")))


def residual_rows(spark: SparkSession, split: str, pairs: int, first: str, second: str, seed: int) -> DataFrame:
    """(place, id, pair_id, pair_type, pair_role, text): half of the pairs of either type, two rows each with the same target.

    A pair_id has four characters of the number, so beyond 10,000 pairs it repeats; place tells pairs apart.
    """
    if pairs < 2 or pairs % 2:
        raise ValueError("an even number of pairs is needed")
    types = exact_values(spark, dict.fromkeys(RESIDUAL_TYPES, 1.0), pairs, seed)
    k = (seed, F.col("place"))
    lines = F.transform(
        F.sequence(F.lit(1), hashed_int(2, 4, *k, "lines")),
        lambda i: F.when(hashed_uniform(*k, "swap", i) < 0.5, F.concat(picked(second, hashed_int(4, 9, *k, "b", i), *k, "bc", i), picked(first, hashed_int(5, 11, *k, "a", i), *k, "ac", i))).otherwise(
            F.concat(picked(first, hashed_int(5, 11, *k, "a", i), *k, "ac", i), picked(second, hashed_int(4, 9, *k, "b", i), *k, "bc", i))
        ),
    )
    made = types.withColumn("pair_id", F.concat(F.lit(f"{split}_residual_"), F.lpad((F.col("place") - 1).cast("string"), 4, "0"))).withColumn("text", t.lines_to_target(lines))
    roles = made.withColumn("pair_role", F.explode(F.array(F.lit("clear"), F.lit("variant"))))
    return roles.select("place", F.concat_ws("_", "pair_id", "pair_role").alias("id"), "pair_id", F.col("value").alias("pair_type"), "pair_role", "text")


def degradation_plan(rows: DataFrame, key: str, profile: str, policy: DataFrame, seed: int) -> DataFrame:
    """rows with operations, ink_mode, class_key, applied and strength: one operation for light rows, two different ones for
    heavy rows (binarize among them), then the sensor's tone; the policy (class_key, strength) caps some classes."""
    k, p = F.col(key), F.col(profile)
    pool = F.when(p == "heavy", F.array(*map(F.lit, (*DEGRADATIONS, "binarize")))).otherwise(F.array(*map(F.lit, DEGRADATIONS)))
    shuffled = F.transform(F.array_sort(F.transform(pool, lambda o: F.struct(hashed_uniform(seed, k, "operation", o).alias("u"), o.alias("o")))), lambda s: s["o"])
    chosen = F.concat(F.slice(shuffled, F.lit(1), F.when(p == "heavy", 2).otherwise(1)), F.array(F.lit("tone_sensor")))
    made = rows.withColumn("operations", F.when(p == "clear_print", F.array().cast("array<string>")).otherwise(chosen))
    ink = F.when(hashed_uniform(seed, k, "ink") < 0.75, "spread_minfilter").otherwise("thinning_maxfilter")
    made = made.withColumn("ink_mode", F.when(F.array_contains("operations", "ink"), ink))
    made = made.withColumn("class_key", F.when(p == "clear_print", F.lit("clear_print")).otherwise(t.class_key(p, F.col("operations"), F.col("ink_mode"))))
    capped = policy.select("class_key", F.col("strength").alias("_strength"))
    joined = made.join(capped, "class_key", "left")
    return joined.withColumn("applied", F.col("_strength").isNotNull()).withColumn("strength", F.coalesce("_strength", F.lit(1.0))).drop("_strength")


def font_coverage(text: DataFrame, cmap: DataFrame, key: str) -> DataFrame:
    """(key, char, fonts): the fonts whose cmap (font, codepoint) has each character; no font means that it is uncovered."""
    chars = text.select(key, F.explode(F.array_distinct(F.split("text", ""))).alias("char")).withColumn("codepoint", F.ascii("char"))
    return chars.join(cmap, "codepoint", "left").groupBy(key, "char").agg(F.array_sort(F.collect_set("font")).alias("fonts"))


def unique_attempts(attempts: DataFrame, key: str, attempt: str, digest: str) -> DataFrame:
    """(key, attempt, digest): rows take turns in the order of `key`, and each takes its first attempt whose digest none
    before it has taken. A row whose attempts are all taken has null for both.

    Rounds of deferred acceptance give the sequential rule's result: an open row proposes its first attempt whose digest is
    free or held by a larger key, a digest keeps the smallest key that ever asked, and who loses it is open again. Holders
    only fall, so an attempt that a smaller key holds is lost for good, and each round moves at least one holder. A round
    sends a row for each open attempt and digest; map-side minima keep a digest that many ask for from piling up. Attempts
    with a null digest take nothing.
    """
    from glyphmill.session import materialise

    tries = materialise(attempts.select(F.col(key).alias("k"), F.col(attempt).alias("a"), F.col(digest).alias("d")), "attempts")
    usable = tries.filter("d is not null")
    held, before = usable.limit(0), (0, None)
    while True:
        placed = held.select("k").distinct()
        holders = held.select("d", F.col("k").alias("_holder"))
        free = usable.join(placed, "k", "left_anti").join(holders, "d", "left").filter("_holder is null or _holder > k")
        proposed = free.groupBy("k").agg(F.min(F.struct("a", "d")).alias("_p")).select("k", "_p.a", "_p.d")
        held = materialise(held.unionByName(proposed).groupBy("d").agg(F.min(F.struct("k", "a")).alias("_h")).select("_h.k", "_h.a", "d"), "held")
        now = tuple(held.agg(F.count("*"), F.sum(F.xxhash64("d", "k").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return tries.select("k").distinct().join(held, "k", "left").select(F.col("k").alias(key), F.col("a").alias(attempt), F.col("d").alias(digest))

"""Integrity rules as queries: each returns the rows that violate it, none if all is well."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as t

# The domains and names that the row contracts refer to.
GRANULARITIES = ("line", "region", "page")
ADDON_FAMILIES = ("latin_retention", "residual_pair")
BANNED_OPERATIONS = ("shear", "gamma")
INK_MODES = ("spread_minfilter", "thinning_maxfilter")
LAST_OPERATION, CLEAR_PROFILE, HEAVY_PROFILE = "tone_sensor", "clear_print", "heavy"
MAX_WORKERS = 32
PAIR_SOURCES = ("tone_arc", "cluster_multifont", "cluster_font_specific", "coverage_floor_multifont_generic")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, and missing or empty ones, with their counts."""
    counts = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    empty = F.col("key").isNull() | (F.col("key").cast("string") == "")
    return counts.filter((F.col("n") > 1) | empty)


def content_duplicates(rows: DataFrame, text: str) -> DataFrame:
    """Content hashes of more than one row."""
    return duplicates(rows.select(t.sha256(F.col(text)).alias("digest")).filter("digest is not null"), "digest").withColumnRenamed("key", "digest")


def outside_domain(rows: DataFrame, column: str, domain: Iterable[str]) -> DataFrame:
    return rows.filter(F.col(column).isNull() | ~F.col(column).isin(*domain))


def overlap(left: DataFrame, right: DataFrame, text: str) -> DataFrame:
    """Content hashes that both sides hold: leakage between splits. Hashes are shuffled, not texts."""
    return left.select(t.sha256(F.col(text)).alias("digest")).intersect(right.select(t.sha256(F.col(text)).alias("digest"))).filter("digest is not null")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: (key, side)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def unexpected_characters(rows: DataFrame, key: str, text: str, allowed: str) -> DataFrame:
    """Rows with characters outside the allowed ones, and those characters."""
    found = rows.select(key, F.array_join(t.unexpected(F.col(text), F.lit(allowed)), "").alias("unexpected"))
    return found.filter("unexpected <> ''")


def uncovered(rows: DataFrame, text: str, alphabet: DataFrame) -> DataFrame:
    """Symbols of the alphabet (symbol) that no text holds."""
    seen = rows.select(F.explode(F.array_distinct(F.split(text, ""))).alias("symbol")).distinct()
    return alphabet.join(seen, "symbol", "left_anti")


def line_violation(granularity: Column, lines: Column, blocks: Column) -> Column:
    """Null, or what is wrong with a target's number of lines."""
    return (
        F.when(~granularity.isin(*GRANULARITIES) | granularity.isNull(), "unknown granularity")
        .when((granularity == "line") & (lines != 1), "line target")
        .when((granularity == "region") & (lines < 3), "region target")
        .when((granularity == "page") & (blocks.isNull() | (blocks != lines)), "page target")
    )


def degradation_violation(profile: Column, operations: Column, ink_mode: Column, applied: Column, strength: Column, expected: Column) -> Column:
    """Null, or what is wrong with a row's degradation record; expected is the policy's strength or null."""
    core = F.size(F.filter(operations, lambda o: o != LAST_OPERATION))
    budget = F.when(profile == HEAVY_PROFILE, 2).otherwise(1)
    has_ink = F.array_contains(operations, "ink")
    return (
        F.when(operations.isNull(), "no operations")
        .when(F.exists(operations, lambda o: o.isin(*BANNED_OPERATIONS)), "banned operation")
        .when((profile == CLEAR_PROFILE) & (F.size(operations) > 0), "clear row is degraded")
        .when(profile == CLEAR_PROFILE, F.lit(None))
        .when((core != budget) | (F.coalesce(F.try_element_at(operations, F.lit(-1)), F.lit("")) != LAST_OPERATION), "operation budget")
        .when(has_ink & ~F.coalesce(ink_mode.isin(*INK_MODES), F.lit(False)), "ink mode unknown")
        .when(~has_ink & ink_mode.isNotNull(), "ink mode without ink")
        .when(applied.isNull(), "no attenuation")
        .when(expected.isNull() & (applied | (strength != 1.0)), "unflagged row altered")
        .when(expected.isNotNull() & (~applied | (strength != expected)), "wrong strength")
    )


def core_row_violations(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Rows (id, granularity, target, blocks, profile, operations, ink_mode, applied, strength) that break the contract of
    core rows, with the first rule they break. policy: (class_key, expected), a small dimension."""
    keyed = rows.withColumn("class_key", t.class_key(F.col("profile"), F.col("operations"), F.col("ink_mode"))).join(policy, "class_key", "left")
    lines = line_violation(F.col("granularity"), t.line_count(F.col("target")), F.col("blocks"))
    rest = degradation_violation(*(F.col(c) for c in ("profile", "operations", "ink_mode", "applied", "strength", "expected")))
    return keyed.select("id", F.coalesce(lines, rest).alias("violation")).filter("violation is not null")


def addon_row_violations(rows: DataFrame) -> DataFrame:
    return outside_domain(rows, "family", ADDON_FAMILIES)


def unsafe_paths(rows: DataFrame, key: str, images: str, folder: str = "images") -> DataFrame:
    """Rows whose images aren't exactly one relative path under the folder, and paths that occur twice."""
    one = F.get(F.col(images), F.lit(0))
    parts = F.split(one, "/")
    bad = (F.size(images) != 1) | one.startswith("/") | (F.get(parts, F.lit(0)) != folder) | F.array_contains(parts, "..")
    single = rows.select(key, images, F.coalesce(bad, F.lit(True)).alias("_bad"), one.alias("_path"))
    twice = single.groupBy("_path").agg(F.count("*").alias("_n")).filter("_n > 1")
    unsafe = single.filter("_bad").select(key, F.lit("unsafe path").alias("violation"))
    again = single.join(twice, "_path", "left_semi").filter("not _bad").select(key, F.lit("duplicate path").alias("violation"))
    return unsafe.unionByName(again)


def pair_integrity(rows: DataFrame, pair: str, role: str, same: list[str], different: list[str], roles: tuple[str, str]) -> DataFrame:
    """Pairs that lack exactly the two roles once each, or whose `same` columns differ, or whose `different` ones agree."""
    agg = rows.groupBy(pair).agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col(role) == r).alias(f"n_{r}") for r in roles),
        *(F.count_distinct(c).alias(f"d_{c}") for c in dict.fromkeys([*same, *different])),
    )
    rule = F.when((F.col("n") != 2) | (F.col(f"n_{roles[0]}") != 1) | (F.col(f"n_{roles[1]}") != 1), "roles")
    for c in same:
        rule = rule.when(F.col(f"d_{c}") != 1, f"{c} differs")
    for c in different:
        rule = rule.when(F.col(f"d_{c}") != 2, f"{c} agrees")
    return agg.select(pair, rule.alias("violation")).filter("violation is not null")


def pair_bank_violations(pairs: DataFrame, alphabet: DataFrame, sources: tuple[str, ...] = PAIR_SOURCES) -> DataFrame:
    """Pairs (a, b, source) out of order, repeated, outside the alphabet (symbol) or of an unknown source."""
    twice = pairs.groupBy("a", "b").agg(F.count("*").alias("_n"))
    known = alphabet.select(F.col("symbol"))
    marked = (
        pairs.join(twice, ["a", "b"])
        .join(known.select(F.col("symbol").alias("a"), F.lit(True).alias("_a")), "a", "left")
        .join(known.select(F.col("symbol").alias("b"), F.lit(True).alias("_b")), "b", "left")
    )
    rule = F.when(F.col("a") >= F.col("b"), "order").when(F.col("_n") > 1, "repeated").when(F.col("_a").isNull() | F.col("_b").isNull(), "alphabet").when(~F.col("source").isin(*sources), "source")
    return marked.select("a", "b", rule.alias("violation")).filter("violation is not null")


def count_mismatches(rows: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Values of key whose counts differ from the expected ones (key, expected), both ways."""
    actual = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("actual"))
    both = expected.join(actual, "key", "full")
    return both.select("key", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).filter("expected <> actual")


def policy_violations(policy: DataFrame, classes: int) -> DataFrame:
    """One row if the policy (class_key, strength) has not exactly `classes` distinct keys with strengths in [0, 1]."""
    found = policy.agg(F.count_distinct("class_key").alias("keys"), F.count("*").alias("rows"), F.count_if(~F.col("strength").between(0, 1)).alias("outside"))
    return found.filter((F.col("keys") != classes) | (F.col("rows") != classes) | (F.col("outside") > 0))


def pinned(path_digests: DataFrame, expected: DataFrame) -> DataFrame:
    """Files (path, digest) whose digest isn't the pinned one."""
    both = expected.withColumnRenamed("digest", "pinned").join(path_digests, "path", "left")
    return both.filter(~F.col("pinned").eqNullSafe(F.col("digest")))


def argument_errors(arguments: Mapping[str, object], forbidden: Iterable[str] = ()) -> list[str]:
    """What is wrong with a build's arguments: names, counts, ratios and shares out of their domains."""
    out = []
    name = str(arguments.get("build_id", ""))
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name):
        out.append("build_id")
    out += [f"build_id: {token}" for token in forbidden if token.casefold() in name.casefold()]
    out += [k for k in ("train_n", "dev_n") if not arguments.get(k, 0) > 0]
    if not 0 < arguments.get("workers", 1) <= MAX_WORKERS:
        out.append("workers")
    ratios = [arguments.get(k, 0.0) for k in ("ratio_yi", "ratio_mixed", "ratio_common")]
    if min(ratios) < 0 or sum(ratios) <= 0:
        out.append("ratios")
    return out + [k for k in ("mixed_yi_frac", "symbol_rate", "heavy_degrade") if not 0.0 <= arguments.get(k, 0.0) <= 1.0]


def authorization_errors(authorization: Mapping[str, object] | None, spec_digest: str) -> list[str]:
    """Why a formal build isn't authorised: no document, the wrong phase, training included, or another specification."""
    if not isinstance(authorization, Mapping):
        return ["document"]
    rules = {
        "phase": authorization.get("phase") == "formal_build_authorized" and authorization.get("formal_build") is True,
        "training": authorization.get("training") is False,
        "spec_sha256": authorization.get("spec_sha256") == spec_digest,
    }
    return [name for name, holds in rules.items() if not holds]


def build_problems(rows: DataFrame, key: str, forbidden: Iterable[str], spec_digest: str) -> DataFrame:
    """(key, errors): what argument_errors and authorization_errors say of many builds, one a row; an empty array is a pass.

    rows: key, build_id, train_n, dev_n, workers, ratio_yi, ratio_mixed, ratio_common, mixed_yi_frac, symbol_rate,
    heavy_degrade, authorization (struct of phase, formal_build, training, spec_sha256, or null). Null arguments have the
    defaults: one worker, else 0 or an empty name.
    """
    name = F.coalesce("build_id", F.lit(""))
    number = lambda c, default=0: F.coalesce(F.col(c).cast("double"), F.lit(float(default)))
    ratios = [number(c) for c in ("ratio_yi", "ratio_mixed", "ratio_common")]
    said = lambda c: F.col(f"authorization.{c}")
    rules = [("build_id", name.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*\z"))]
    rules += [(f"build_id: {token}", ~F.lower(name).contains(token.lower())) for token in forbidden]
    rules += [(c, number(c) > 0) for c in ("train_n", "dev_n")]
    rules += [("workers", (number("workers", 1) > 0) & (number("workers", 1) <= MAX_WORKERS)), ("ratios", (F.least(*ratios) >= 0) & (ratios[0] + ratios[1] + ratios[2] > 0))]
    rules += [(c, number(c).between(0, 1)) for c in ("mixed_yi_frac", "symbol_rate", "heavy_degrade")]
    rules += [("document", F.col("authorization").isNotNull())]
    held = {"phase": (said("phase") == "formal_build_authorized") & said("formal_build"), "training": ~said("training"), "spec_sha256": said("spec_sha256") == spec_digest}
    rules += [(c, F.col("authorization").isNull() | F.coalesce(rule, F.lit(False))) for c, rule in held.items()]
    return rows.select(key, F.array_compact(F.array(*(F.when(~rule, F.lit(c)) for c, rule in rules))).alias("errors"))

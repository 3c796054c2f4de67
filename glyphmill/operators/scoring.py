"""Row scores, grouped metrics in two dialects, and the rankings over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as t

FLAGS = ("replacement", "latex", "ascii_letter", "gt_ascii_letter", "extra_ascii_letter", "ascii_any", "long_pred")


def score_rows(rows: DataFrame, first: str = t.YI_BLOCK, second: str = t.HAN, digits: str = t.DIGITS, compatibility: bool = True) -> DataFrame:
    """rows (pred, gt) with distances, rates, lengths and flags; a slice's rate is null where the truth lacks the slice.

    Slices are projected once and shared by all that follows. Without `compatibility` the NFKC columns repeat the plain
    ones, for corpora known to be in that form, and no Python runs.
    """
    pred, gt = F.col("pred"), F.col("gt")
    sliced = rows.withColumns(
        {
            "_ws_p": t.strip_ws(pred),
            "_ws_g": t.strip_ws(gt),
            "_k_p": t.nfkc_ws(pred) if compatibility else t.strip_ws(pred),
            "_k_g": t.nfkc_ws(gt) if compatibility else t.strip_ws(gt),
            **{f"_{n}_{s}": t.keep(c, chars) for n, chars in (("yi", first), ("han", second), ("digit", digits)) for s, c in (("p", pred), ("g", gt))},
        }
    )
    # one distance each for the raw and the plain texts; most texts are in compatibility form already and share the latter
    sliced = sliced.withColumns({"dist": t.distance(pred, gt), "ws_ned": t.ned(F.col("_ws_p"), F.col("_ws_g"))})

    def part(name: str) -> Column:
        return F.when(F.col(f"_{name}_g") != "", t.ned(F.col(f"_{name}_p"), F.col(f"_{name}_g")))

    scored = sliced.withColumns(
        {
            "ned": t.ned(pred, gt, F.col("dist")),
            "exact": pred == gt,
            "ws_exact": F.col("_ws_p") == F.col("_ws_g"),
            "nfkc_ws_ned": F.when((F.col("_k_p") == F.col("_ws_p")) & (F.col("_k_g") == F.col("_ws_g")), F.col("ws_ned")).otherwise(t.ned(F.col("_k_p"), F.col("_k_g"))),
            "nfkc_ws_exact": F.col("_k_p") == F.col("_k_g"),
            **{f"{n}_ned": part(n) for n in ("yi", "han", "digit")},
            **{f"{n}_exact": F.when(F.col(f"_{n}_g") != "", F.col(f"_{n}_p") == F.col(f"_{n}_g")) for n in ("yi", "han", "digit")},
            "gt_len": F.length(gt),
            "pred_len": F.length(pred),
            **{f"{s}_{n}_len": F.length(f"_{n}_{s[0]}") for n in ("yi", "han") for s in ("gt", "pred")},
            **{f"flag_{k}": v for k, v in t.flags(pred, gt).items()},
        }
    )
    return scored.drop(*(c for c in scored.columns if c.startswith("_")))


def _rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def metric_columns() -> list[Column]:
    """The 23 metrics of a group, in order; rates of an empty group are null."""
    out = [F.count("*").alias("n")]
    for name in ("", "ws_", "nfkc_ws_"):
        out += [F.avg(f"{name}ned").alias(f"{name}ned"), _rate(f"{name}exact").alias(f"{name}exact")]
    for name in ("yi", "han", "digit"):
        out += [F.avg(f"{name}_ned").alias(f"{name}_ned"), _rate(f"{name}_exact").alias(f"{name}_exact"), F.count(f"{name}_ned").alias(f"{name}_rows")]
    return out + [F.count_if(f"flag_{k}").alias(k) for k in FLAGS]


def metric_pack(scored: DataFrame) -> DataFrame:
    return scored.agg(*metric_columns())


def group_metrics(scored: DataFrame, key: str) -> DataFrame:
    """The metrics of each value of key as text (True/False for booleans), the largest group first, then by key."""
    named = F.initcap(F.col(key).cast("string")) if scored.schema[key].dataType.simpleString() == "boolean" else F.col(key).cast("string")
    grouped = scored.withColumn(key, F.coalesce(named, F.lit(""))).groupBy(key).agg(*metric_columns())
    return grouped.orderBy(F.desc("n"), key)


def metrics_by_keys(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics by each of the keys in one pass (grouping sets): key_name, key_value, metrics."""
    texts = scored.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    grouped = texts.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(*(F.grouping(k).alias(f"_g_{k}") for k in keys), *metric_columns())
    name = F.coalesce(*(F.when(F.col(f"_g_{k}") == 0, F.lit(k)) for k in keys))
    value = F.coalesce(*(F.when(F.col(f"_g_{k}") == 0, F.col(k)) for k in keys))
    return grouped.select(name.alias("key_name"), value.alias("key_value"), *(c for c in grouped.columns if c not in keys and not c.startswith("_g_")))


def formatted(metrics: DataFrame) -> DataFrame:
    """Floats as six-decimal texts, missing ones empty; other columns unchanged."""
    return metrics.select(*(t.six_decimals(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in metrics.dtypes))


# -- strict dialect ------------------------------------------------------------------------------------------------


def score_strict(rows: DataFrame, first: str = t.YI_SYLLABLES, normal: bool = True) -> DataFrame:
    """The strict dialect's columns: rates over composed text without white space, raw and compatibility ones beside."""
    pred, gt = F.col("pred"), F.col("gt")
    form, wide = (t.nfc_ws, t.nfkc_ws) if normal else (t.strip_ws, t.strip_ws)
    made = rows.withColumns({"_p": form(pred), "_g": form(gt), "_kp": wide(pred), "_kg": wide(gt)})
    made = made.withColumns({"_yp": t.keep(F.col("_p"), first), "_yg": t.keep(F.col("_g"), first)})
    out = made
    for name, p, g in (("", "_p", "_g"), ("raw_", "pred", "gt"), ("nfkc_", "_kp", "_kg"), ("yi_", "_yp", "_yg")):
        out = out.withColumn(f"{name}edit_distance", t.distance(F.col(p), F.col(g)).cast("long"))
        out = out.withColumns({f"{name}ned": t.ned(F.col(p), F.col(g), F.col(f"{name}edit_distance")), f"{name}gt_characters": F.length(g).cast("long"), f"{name}prediction_characters": F.length(p).cast("long")})
    out = out.withColumn("exact", F.col("_p") == F.col("_g"))
    return out.drop("_p", "_g", "_kp", "_kg", "_yp", "_yg", "raw_prediction_characters", "nfkc_prediction_characters")


def summary_columns() -> list[Column]:
    """The strict summary: sums, corpus rate, mean rate, exact matches; rates of nothing are null."""
    return [
        F.count("ned").alias("samples"),
        F.coalesce(F.sum("gt_characters"), F.lit(0)).alias("gt_characters"),
        F.coalesce(F.sum("prediction_characters"), F.lit(0)).alias("prediction_characters"),
        F.coalesce(F.sum("edit_distance"), F.lit(0)).alias("edit_distance"),
        F.try_divide(F.sum("edit_distance"), F.sum("gt_characters")).alias("cer"),
        F.avg("ned").alias("mean_sample_ned"),
        F.count_if("exact").alias("exact_matches"),
        _rate("exact").alias("exact_match_rate"),
    ]


def summarize(scored: DataFrame) -> DataFrame:
    return scored.agg(*summary_columns())


def overall(scored: DataFrame) -> DataFrame:
    """The summary and the raw, compatibility and script-only rates over all rows."""
    more = []
    for name in ("raw", "nfkc"):
        more += [F.try_divide(F.sum(f"{name}_edit_distance"), F.sum(f"{name}_gt_characters")).alias(f"{name}_cer"), F.avg(f"{name}_ned").alias(f"{name}_mean_sample_ned")]
    more += [
        F.sum("yi_gt_characters").alias("yi_gt_characters"),
        F.sum("yi_edit_distance").alias("yi_edit_distance"),
        F.try_divide(F.sum("yi_edit_distance"), F.sum("yi_gt_characters")).alias("yi_cer"),
        F.avg("yi_ned").alias("yi_mean_sample_ned"),
    ]
    return scored.agg(*summary_columns(), *more)


def breakdown(scored: DataFrame, key: str, domain: DataFrame) -> DataFrame:
    """The summary of each value of a fixed domain (ord, key, label) in its order; values without rows keep a row."""
    grouped = scored.groupBy(key).agg(*summary_columns())
    joined = domain.join(grouped, domain["key"] == grouped[key], "left").drop(grouped[key])
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("samples", "gt_characters", "prediction_characters", "edit_distance", "exact_matches")}
    return joined.withColumns(zero).orderBy("ord").drop("ord")


def mean_ned(rows: DataFrame) -> DataFrame:
    """The quick score: pairs without characters add 0 and count; 0 where there is no pair."""
    longer = F.greatest(F.length("pred"), F.length("gt"))
    rate = F.when(longer > 0, t.distance(F.col("pred"), F.col("gt")) / longer).otherwise(F.lit(0.0))
    return rows.agg(F.coalesce(F.avg(rate), F.lit(0.0)).alias("mean_ned"), F.count("*").alias("n"))


# -- rankings and details ------------------------------------------------------------------------------------------


def worst(scored: DataFrame, k: int, position: str) -> DataFrame:
    """The k worst rows with their rank; ties keep the input's order. A top-k, not a sort of all rows."""
    top = scored.orderBy(F.desc("ned"), F.desc("ws_ned"), F.desc("gt_len"), position).limit(k)
    keys = F.struct((-F.col("ned")).alias("a"), (-F.col("ws_ned")).alias("b"), (-F.col("gt_len")).alias("c"), F.col(position).alias("d"))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(keys)))


def active_flags() -> Column:
    """The names of the row's flags, in order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.col(f"flag_{k}"), F.lit(k)) for k in FLAGS))), ",")


def details(scored: DataFrame, key: str) -> DataFrame:
    """The detail rows, worst first: formatted rates, lengths, flags."""
    shown = [t.six_decimals(F.col(c)).alias(c) for c in ("ned", "ws_ned", "nfkc_ws_ned", "yi_ned", "han_ned")]
    rows = scored.select(key, "dist", *shown, "gt_len", "pred_len", active_flags().alias("flags"), F.col("ned").alias("_a"), F.col("ws_ned").alias("_b"))
    return rows.orderBy(F.desc("_a"), F.desc("_b"), key).drop("_a", "_b")


def danger_rows(scored: DataFrame, key: str) -> DataFrame:
    return details(scored, key).filter("flags <> ''")


def contribution(scored: DataFrame, anomaly: Column) -> DataFrame:
    """The share of rows and of the summed rate that anomalous rows make up."""
    return scored.agg(
        F.count_if(anomaly).alias("rows"),
        F.try_divide(F.count_if(anomaly), F.count("*")).alias("row_share"),
        F.try_divide(F.sum(F.when(anomaly, F.col("ned")).otherwise(0.0)), F.sum("ned")).alias("ned_share"),
    )


def compare_runs(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """How many samples of two runs became better, equal, worse."""
    both = before.select(key, F.col("ned").alias("_a")).join(after.select(key, F.col("ned").alias("_b")), key)
    change = F.when(F.col("_b") < F.col("_a"), "better").when(F.col("_b") > F.col("_a"), "worse").otherwise("equal")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))

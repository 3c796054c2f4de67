"""Evaluation queries on the test tables: a user turn stands in for a prediction, the next assistant turn for the truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators import alignment, scoring

Query = Callable[[SparkSession, str], DataFrame]

#: Stand-ins for the two scripts, which the test tables lack: vowels, and accented Latin letters.
FIRST, SECOND, DIGITS = "aeiou", "\\u00C0-\\u024F", "0-9"
SCENES = (("book_scan", "Book scan"), ("real_screen_photo", "Screen photo"), ("phone_handwritten", "Handwriting"), ("real_photo", "Photo"))
KEYS = ("source_name", "sample_type", "script_mix", "difficulty", "scene", "has_digit")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(rows: DataFrame, digits: int = 9) -> DataFrame:
    """Sums of doubles differ in their last bits with the order of rows."""
    return rows.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("pred"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gt"))
    n = F.length("gt")
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"),
        "pred",
        "gt",
        F.concat(F.lit("src"), F.col("conv_id") % 7).alias("source_name"),
        F.when(F.col("turn") < 2, "page").otherwise("region").alias("sample_type"),
        F.when(F.col("gt").rlike("[^\\x00-\\x7f]"), "mixed").otherwise("latin").alias("script_mix"),
        F.when(n < 200, "easy").when(n < 500, "medium").otherwise("hard").alias("difficulty"),
        F.element_at(F.array(*(F.lit(k) for k, _ in SCENES)), (F.col("conv_id") % 3 + 1).cast("int")).alias("scene"),
        F.col("gt").rlike("[0-9]").alias("has_digit"),
    )


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key before the costly distances: few input splits would else hold all the long texts."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_rows(spread(pairs(spark, sf_dir), "sample_id"), FIRST, SECOND, DIGITS)


def strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_strict(spread(pairs(spark, sf_dir), "sample_id"), FIRST)


def _scenes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, label) for i, (k, label) in enumerate(SCENES)], "ord int, key string, label string")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return grouped.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


def _digested(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*(c for c in rows.columns if c not in columns), *(t.sha256(F.col(c)).alias(f"{c}_sha") for c in columns))


def eval_align_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    annotations = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("gt"))
    results = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("answer"))
    joined = alignment.align(annotations, results, "conv_id", "turn")
    return _digested(joined.select("conv_id", "gt", alignment.answer_text(F.col("answer")).alias("pred")), "gt", "pred")


def eval_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def eval_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.missing(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")), table(spark, sf_dir, "documents"), "doc_id")


def eval_align_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairs(spark, sf_dir)
    return _digested(alignment.align_strict(both.select("sample_id", "gt"), both.select("sample_id", "pred"), "sample_id"), "gt", "pred")


def last_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(_messages(spark, sf_dir).select("conv_id", alignment.assistant_text(F.col("messages")).alias("content")), "content")


def strict_assistant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter("messages", lambda m: m["role"] == "assistant"))
    return _messages(spark, sf_dir).select("conv_id", n.cast("long").alias("n")).filter("n <> 1")


def flat_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source_name"), F.col("lang").alias("script_mix")).alias("meta"))
    return docs.select("doc_id", *(c.alias(n) for n, c in alignment.flat_meta(docs).items()))


def ned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ["sample_id", "dist", "ned", "ws_ned", "nfkc_ws_ned", "yi_ned", "han_ned", "gt_len", "pred_len", "gt_yi_len", "pred_yi_len", "gt_han_len", "pred_han_len"]
    return rounded(scored(spark, sf_dir).select(*shown, *(f"flag_{f}" for f in scoring.FLAGS)))


def ned_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.metric_pack(scored(spark, sf_dir)))


def ned_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.group_metrics(scored(spark, sf_dir), "source_name"))


def ned_by_has_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.group_metrics(scored(spark, sf_dir), "has_digit"))


def metric_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.metrics_by_keys(scored(spark, sf_dir), list(KEYS)))


def metric_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.formatted(rounded(scoring.group_metrics(scored(spark, sf_dir), "difficulty")).select("difficulty", "n", "ned", "han_ned", "latex"))


def ned_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.mean_ned(spread(pairs(spark, sf_dir), "sample_id")))


def ned_strict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = strict(spark, sf_dir)
    return rounded(rows.select("sample_id", *(c for c in rows.columns if c.endswith(("edit_distance", "ned", "characters"))), "exact"))


def ned_strict_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.breakdown(strict(spark, sf_dir), "scene", _scenes(spark)))


def ned_strict_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.overall(strict(spark, sf_dir)))


def worst_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.worst(scored(spark, sf_dir), 180, "sample_id").select("rank", "sample_id", "ned", "ws_ned", "gt_len"))


def detail_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.details(scored(spark, sf_dir), "sample_id")


def danger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.danger_rows(scored(spark, sf_dir), "sample_id")


def contribution_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.contribution(scored(spark, sf_dir), F.col("flag_long_pred")))


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return scoring.compare_runs(rows.select("sample_id", "ned"), rows.select("sample_id", F.col("ws_ned").alias("ned")), "sample_id")


def scene_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).join(F.broadcast(_scenes(spark)), F.col("scene") == F.col("key")).select("sample_id", "label")  # four rows


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        eval_align_left, eval_missing, eval_extra, eval_align_strict, last_assistant, strict_assistant_violations, flat_meta, ned_rows, ned_overall, ned_by_source, ned_by_has_digit,
        metric_grouping_sets, metric_formatting, ned_quick, ned_strict_rows, ned_strict_breakdown, ned_strict_overall, worst_k, detail_sorted, danger_rows, contribution_share, run_comparison, scene_labels,
    )
}

# -- SQL -----------------------------------------------------------------------------------------------------------
# DuckDB's levenshtein counts bytes; the tables' 21 letters outside ASCII are first mapped to unused control characters.

_LETTERS = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ"
_CODES = "||".join(f"chr({c})" for c in [*range(1, 9), 11, 12, *range(14, 25)])


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 0 ELSE levenshtein(translate({a}, '{_LETTERS}', {_CODES}), translate({b}, '{_LETTERS}', {_CODES})) END"


def _ned(a: str, b: str, dist: str | None = None) -> str:
    return f"(({dist or _lev(a, b)})::DOUBLE / greatest(length({a}), length({b}), 1))"


def _keep(text: str, characters: str) -> str:
    return f"regexp_replace({text}, '[^{characters}]', '', 'g')"


_WS = "[\\s\\x1c-\\x1f\\x{85}\\p{Z}]"
_SQL_SECOND = "\\x{00C0}-\\x{024F}"

PAIRS = """pairs AS (
  SELECT u.conv_id * 1000 + u.turn AS sample_id, u.text AS pred, a.text AS gt, 'src' || (u.conv_id % 7) AS source_name, CASE WHEN u.turn < 2 THEN 'page' ELSE 'region' END AS sample_type,
    CASE WHEN regexp_matches(a.text, '[^\\x00-\\x7f]') THEN 'mixed' ELSE 'latin' END AS script_mix,
    CASE WHEN length(a.text) < 200 THEN 'easy' WHEN length(a.text) < 500 THEN 'medium' ELSE 'hard' END AS difficulty,
    ['book_scan', 'real_screen_photo', 'phone_handwritten'][u.conv_id % 3 + 1] AS scene, regexp_matches(a.text, '[0-9]') AS has_digit
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""

_FLAGS = {
    "replacement": "contains(pred, chr(65533))",
    "latex": "(" + " OR ".join(f"contains(pred, '{x}')" for x in t.LATEX_TOKENS) + ")",
    "ascii_letter": "regexp_matches(pred, '[A-Za-z]')",
    "gt_ascii_letter": "regexp_matches(gt, '[A-Za-z]')",
    "extra_ascii_letter": "(regexp_matches(pred, '[A-Za-z]') AND NOT regexp_matches(gt, '[A-Za-z]'))",
    "ascii_any": "regexp_matches(pred, '[\\x00-\\x7f]')",
    "long_pred": "(contains(pred, repeat(chr(65533), 20)) OR length(pred) >= greatest(120, 4 * length(gt)))",
}
_SLICES = {"yi": FIRST, "han": _SQL_SECOND, "digit": DIGITS}
SCORED = (
    f"WITH {PAIRS},\nsliced AS (SELECT *, regexp_replace(pred, '{_WS}', '', 'g') AS ws_p, regexp_replace(gt, '{_WS}', '', 'g') AS ws_g, "
    + ", ".join(f"{_keep(c, chars)} AS {n}_{s}" for n, chars in _SLICES.items() for s, c in (("p", "pred"), ("g", "gt")))
    + f", {_lev('pred', 'gt')} AS dist FROM pairs),\nscored AS (SELECT *, {_ned('pred', 'gt', 'dist')} AS ned, pred = gt AS exact, {_ned('ws_p', 'ws_g')} AS ws_ned, ws_p = ws_g AS ws_exact, {_ned('ws_p', 'ws_g')} AS nfkc_ws_ned, ws_p = ws_g AS nfkc_ws_exact, "
    + ", ".join(f"CASE WHEN {n}_g <> '' THEN {_ned(n + '_p', n + '_g')} END AS {n}_ned, CASE WHEN {n}_g <> '' THEN {n}_p = {n}_g END AS {n}_exact" for n in _SLICES)
    + ", length(gt)::INT AS gt_len, length(pred)::INT AS pred_len, "
    + ", ".join(f"length({n}_{s[0]})::INT AS {s}_{n}_len" for n in ("yi", "han") for s in ("gt", "pred"))
    + ", "
    + ", ".join(f"{v} AS flag_{k}" for k, v in _FLAGS.items())
    + " FROM sliced)\n"
)


def _metrics() -> str:
    out = ["count(*) AS n"]
    for name in ("", "ws_", "nfkc_ws_"):
        out += [f"round(avg({name}ned), 9) AS {name}ned", f"round(avg({name}exact::INT), 9) AS {name}exact"]
    for name in _SLICES:
        out += [f"round(avg({name}_ned), 9) AS {name}_ned", f"round(avg({name}_exact::INT), 9) AS {name}_exact", f"count({name}_ned) AS {name}_rows"]
    return ", ".join(out + [f"count(*) FILTER (flag_{k}) AS {k}" for k in scoring.FLAGS])


_STRICT_PARTS = {"": ("ws_p", "ws_g"), "raw_": ("pred", "gt"), "nfkc_": ("ws_p", "ws_g"), "yi_": ("sy_p", "sy_g")}
STRICT = (
    f"WITH {PAIRS},\nsliced AS (SELECT *, regexp_replace(pred, '{_WS}', '', 'g') AS ws_p, regexp_replace(gt, '{_WS}', '', 'g') AS ws_g FROM pairs),\n"
    f"kept AS (SELECT *, {_keep('ws_p', FIRST)} AS sy_p, {_keep('ws_g', FIRST)} AS sy_g FROM sliced),\nscored AS (SELECT *, ws_p = ws_g AS exact, "
    + ", ".join(
        f"({_lev(p, g)})::BIGINT AS {n}edit_distance, {_ned(p, g)} AS {n}ned, length({g})::BIGINT AS {n}gt_characters" + (f", length({p})::BIGINT AS {n}prediction_characters" if n in ("", "yi_") else "") for n, (p, g) in _STRICT_PARTS.items()
    )
    + " FROM kept)\n"
)
_SUMMARY = (
    "count(ned) AS samples, coalesce(sum(gt_characters), 0)::BIGINT AS gt_characters, coalesce(sum(prediction_characters), 0)::BIGINT AS prediction_characters, coalesce(sum(edit_distance), 0)::BIGINT AS edit_distance,"
    " round(sum(edit_distance)::DOUBLE / nullif(sum(gt_characters), 0), 9) AS cer, round(avg(ned), 9) AS mean_sample_ned, count(*) FILTER (exact) AS exact_matches, round(avg(exact::INT), 9) AS exact_match_rate"
)
_SHOWN = ", ".join(f"CASE WHEN {c} IS NULL THEN '' ELSE printf('%.6f', {c}) END AS {c}" for c in ("ned", "ws_ned", "nfkc_ws_ned", "yi_ned", "han_ned"))
_ACTIVE = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN flag_{k} THEN '{k}' END" for k in scoring.FLAGS) + "], lambda x: x IS NOT NULL), ',')"
_DETAILS = f"SELECT sample_id, dist::INT AS dist, {_SHOWN}, gt_len, pred_len, {_ACTIVE} AS flags FROM scored"
_MESSAGES = "SELECT conv_id, arg_max(text, turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY conv_id"

ORACLES: dict[str, str] = {
    "eval_align_left": f"""WITH a AS ({_MESSAGES}), r AS (SELECT conv_id, arg_max(text, turn) AS answer FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT a.conv_id, sha256(a.content) AS gt_sha, sha256(coalesce(r.answer, '')) AS pred_sha FROM a LEFT JOIN r USING (conv_id)""",
    "eval_missing": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "eval_extra": "SELECT DISTINCT user_id AS doc_id FROM events WHERE user_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)",
    "eval_align_strict": f"WITH {PAIRS} SELECT sample_id, sha256(gt) AS gt_sha, sha256(pred) AS pred_sha FROM pairs",
    "last_assistant": f"SELECT c.conv_id, sha256(coalesce(m.content, '')) AS content_sha FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ({_MESSAGES}) m USING (conv_id)",
    "strict_assistant_violations": "SELECT conv_id, count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') <> 1",
    "flat_meta": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, '') ELSE '' END AS source_name, '' AS source_code, '' AS sample_type, coalesce(lang, '') AS script_mix, '' AS difficulty, '' AS scene, '' AS source_category, false AS has_digit, '' AS original_id FROM documents",
    "ned_rows": SCORED
    + "SELECT sample_id, dist::INT AS dist, "
    + ", ".join(f"round({c}, 9) AS {c}" for c in ("ned", "ws_ned", "nfkc_ws_ned", "yi_ned", "han_ned"))
    + ", gt_len, pred_len, gt_yi_len, pred_yi_len, gt_han_len, pred_han_len, "
    + ", ".join(f"flag_{k}" for k in scoring.FLAGS)
    + " FROM scored",
    "ned_overall": f"{SCORED}SELECT {_metrics()} FROM scored",
    "ned_by_source": f"{SCORED}SELECT source_name, {_metrics()} FROM scored GROUP BY source_name ORDER BY n DESC, source_name",
    "ned_by_has_digit": f"{SCORED}SELECT CASE WHEN has_digit THEN 'True' ELSE 'False' END AS has_digit, {_metrics()} FROM scored GROUP BY 1",
    "metric_grouping_sets": SCORED + " UNION ALL ".join(f"SELECT '{k}' AS key_name, {k}::VARCHAR AS key_value, {_metrics()} FROM scored GROUP BY {k}" for k in KEYS),
    "metric_formatting": f"{SCORED}SELECT difficulty, count(*) AS n, printf('%.6f', round(avg(ned), 9)) AS ned, CASE WHEN count(han_ned) = 0 THEN '' ELSE printf('%.6f', round(avg(han_ned), 9)) END AS han_ned, count(*) FILTER (flag_latex) AS latex FROM scored GROUP BY difficulty",
    "ned_quick": f"WITH {PAIRS} SELECT round(coalesce(avg(CASE WHEN greatest(length(pred), length(gt)) > 0 THEN ({_lev('pred', 'gt')})::DOUBLE / greatest(length(pred), length(gt)) ELSE 0 END), 0), 9) AS mean_ned, count(*) AS n FROM pairs",
    "ned_strict_rows": STRICT
    + "SELECT sample_id, "
    + ", ".join(f"{n}edit_distance, round({n}ned, 9) AS {n}ned, {n}gt_characters" + (f", {n}prediction_characters" if n in ("", "yi_") else "") for n in _STRICT_PARTS)
    + ", exact FROM scored",
    "ned_strict_breakdown": STRICT
    + f", domain AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in SCENES)}) d(key, label)) SELECT key, label, {_SUMMARY} FROM domain LEFT JOIN scored ON scene = key GROUP BY key, label".replace("coalesce(sum", "coalesce(sum"),
    "ned_strict_overall": STRICT
    + f"SELECT {_SUMMARY}, "
    + ", ".join(f"round(sum({n}_edit_distance)::DOUBLE / nullif(sum({n}_gt_characters), 0), 9) AS {n}_cer, round(avg({n}_ned), 9) AS {n}_mean_sample_ned" for n in ("raw", "nfkc", "yi"))
    + ", sum(yi_gt_characters)::BIGINT AS yi_gt_characters, sum(yi_edit_distance)::BIGINT AS yi_edit_distance FROM scored",
    "worst_k": SCORED + "SELECT row_number() OVER (ORDER BY ned DESC, ws_ned DESC, gt_len DESC, sample_id)::INT AS rank, sample_id, round(ned, 9) AS ned, round(ws_ned, 9) AS ws_ned, gt_len FROM scored QUALIFY rank <= 180",
    "detail_sorted": SCORED + _DETAILS,
    "danger_rows": f"{SCORED}SELECT * FROM ({_DETAILS}) WHERE flags <> ''",
    "contribution_share": SCORED + "SELECT count(*) FILTER (flag_long_pred) AS rows, round(count(*) FILTER (flag_long_pred) / count(*)::DOUBLE, 9) AS row_share, round(sum(CASE WHEN flag_long_pred THEN ned ELSE 0 END) / sum(ned), 9) AS ned_share FROM scored",
    "run_comparison": SCORED + "SELECT CASE WHEN ws_ned < ned THEN 'better' WHEN ws_ned > ned THEN 'worse' ELSE 'equal' END AS change, count(*) AS n FROM scored GROUP BY 1",
    "scene_labels": f"WITH {PAIRS} SELECT sample_id, CASE scene WHEN 'book_scan' THEN 'Book scan' WHEN 'real_screen_photo' THEN 'Screen photo' ELSE 'Handwriting' END AS label FROM pairs",
}

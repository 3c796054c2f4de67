"""Audit queries on the test tables: normal forms, integrity rules, histograms, leakage, lookups, manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators import alignment, constraints, histograms
from glyphmill.plans.evaluation import FIRST, SECOND, rounded, table
from glyphmill.sources import files

Query = Callable[[SparkSession, str], DataFrame]

ALLOWED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,\n"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
MARKS = ".,;:!?"
STRENGTHS = {"AFRICA|a -> tone_sensor|none": 0.25, "ASIA|b -> tone_sensor|ink": 0.8}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _symbols(spark: SparkSession, symbols: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in symbols], "symbol string")


def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", t.sha256(t.strip_ws(text)).alias("ws"), t.sha256(t.nfc_ws(text)).alias("nfc"))


def script_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"first": FIRST, "second": SECOND, "digits": "0-9"}
    return _docs(spark, sf_dir).select("doc_id", *(t.sha256(t.keep(F.col("text"), c)).alias(n) for n, c in parts.items()), F.length(t.keep(F.col("text"), FIRST)).cast("long").alias("n_first"))


def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.count_of(F.col("text"), MARKS).cast("long").alias("n"), F.col("text").rlike("[A-Za-z]").alias("has_letter"), t.has_any(F.col("text"), ("***", "&&&")).alias("has_noise"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.line_count(F.col("text")).cast("long").alias("n_lines"))


def granularity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("line", "region", "page", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _docs(spark, sf_dir).select("doc_id", kind.alias("g"), t.line_count(F.col("text")).alias("n"))
    return rows.select("doc_id", constraints.line_violation(F.col("g"), F.col("n"), F.lit(5)).alias("violation")).filter("violation is not null")


def _core_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as degradation records; a few break each rule."""
    k = F.col("event_id")
    profile = F.when(k % 11 == 0, "clear_print").when(k % 3 == 0, "heavy").otherwise("light")
    tone = F.array(F.lit("tone_sensor"))
    ops = F.when((k % 11 == 0) & (k % 2 == 0), F.array().cast("array<string>")).when(k % 3 == 0, F.concat(F.array(F.lit("ink"), F.lit("blur")), tone)).when(k % 7 == 0, F.array(F.lit("gamma"))).otherwise(F.concat(F.array(F.lit("blur")), tone))
    return table(spark, sf_dir, "events").select(
        k.alias("id"),
        F.lit("line").alias("granularity"),
        F.lit("one\n").alias("target"),
        F.lit(None).cast("int").alias("blocks"),
        profile.alias("profile"),
        ops.alias("operations"),
        F.when((k % 3 == 0) & (k % 5 != 0), "spread_minfilter").alias("ink_mode"),
        (k % 3 == 0).alias("applied"),
        F.when(k % 3 == 0, 0.8).otherwise(1.0).alias("strength"),
    )


def core_row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = spark.createDataFrame([("heavy|ink -> blur -> tone_sensor|spread_minfilter", 0.8)], "class_key string, expected double")
    return constraints.core_row_violations(_core_rows(spark, sf_dir), policy)


def enum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.outside_domain(_docs(spark, sf_dir), "lang", ("en", "fr", "de")).select("doc_id", "lang")


def addon_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(F.col("doc_id") % 3 == 0, "latin_retention").when(F.col("doc_id") % 3 == 1, "residual_pair").otherwise(F.col("lang"))
    return constraints.addon_row_violations(_docs(spark, sf_dir).select("doc_id", family.alias("family")))


def unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    image = F.when(k % 10 == 0, "/abs/a.png").when(k % 10 == 1, "images/../b.png").when(k % 10 == 2, "images/same.png").otherwise(F.concat(F.lit("images/"), k.cast("string"), F.lit(".png")))
    return constraints.unsafe_paths(table(spark, sf_dir, "pages").select("page_id", F.array(image).alias("images")), "page_id", "images")


def id_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey")


def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.content_duplicates(_docs(spark, sf_dir), "text")


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return constraints.overlap(docs.filter("doc_id % 10 > 0"), docs.filter("doc_id % 10 = 0"), "text")


def bench_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lines that documents share with the benchmark's texts."""
    lines = _docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("text"))
    return constraints.overlap(lines, table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("text")), "text")


def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.key_differences(_docs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


def unexpected_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.unexpected_characters(_docs(spark, sf_dir), "doc_id", "text", ALLOWED)


def alphabet_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.uncovered(_docs(spark, sf_dir).filter("lang = 'fr'"), "text", _symbols(spark, ALPHABET))


def pair_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.length("role").alias("same"), t.sha256(F.col("text")).alias("digest"))
    return constraints.pair_integrity(turns, "conv_id", "role", ["same"], ["digest"], ("user", "assistant"))


def count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([(f"src{i}", 50) for i in range(22)], "key string, expected long")
    return constraints.count_mismatches(_docs(spark, sf_dir), "source", expected)


def pair_bank_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = lambda c: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz#"), (c % 27 + 1).cast("int"), F.lit(1))
    bank = table(spark, sf_dir, "supplier").select(letter(F.col("s_suppkey")).alias("a"), letter(F.col("s_suppkey") * 7 + 3).alias("b"), F.when(F.col("s_suppkey") % 5 == 0, "unknown").otherwise("tone_arc").alias("source"))
    return constraints.pair_bank_violations(bank, _symbols(spark, ALPHABET))


def _keyed_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])  # five rows
    ops = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("a"), F.lit("tone_sensor"))).otherwise(F.array(F.lit("b"), F.lit("tone_sensor")))
    ink = F.when(F.col("n_nationkey") % 3 == 0, "ink")
    return both.select("n_nationkey", t.class_key(F.col("r_name"), ops, ink).alias("class_key"))


def class_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed_nations(spark, sf_dir)


def attenuation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = spark.createDataFrame(list(STRENGTHS.items()), "class_key string, strength double")
    return alignment.with_default(_keyed_nations(spark, sf_dir), F.broadcast(policy), "class_key", "strength", 1.0).select("n_nationkey", "class_key", "strength", "applied")


def hist_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.counts(_docs(spark, sf_dir), "lang").orderBy("key")


def hist_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.counts(_docs(spark, sf_dir), "lang", "source").orderBy("key")


def hist_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir)
    return histograms.nested(rows, {"mark": F.filter(F.split("text", ""), lambda c: c.isin(*MARKS)), "lang": F.array("lang"), "digit": F.regexp_extract_all("text", F.lit("[0-9]"), F.lit(0))})


def hist_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("font"), F.get_json_object("props", "$.k").cast("int").alias("k")).withColumn("place", F.col("k") % 4)
    return histograms.grouping_sets(rows, [["event_type"], ["font"], ["place"], ["event_type", "font"]])


def hist_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.zero_filled(_docs(spark, sf_dir), "text", _symbols(spark, "abc019#%é~"))


def hist_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = t.count_of(F.col("text"), MARKS)
    return histograms.conditional(_docs(spark, sf_dir), {"with_symbol": marks > 0, "without_symbol": marks == 0, "long_rows": F.col("n_chars") > 5000}, {"symbol_characters": marks})


def events_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.events_by(_docs(spark, sf_dir), "lang", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.distinct_counts(_docs(spark, sf_dir), ["doc_id", "text", "source"])


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(histograms.percentiles(_docs(spark, sf_dir), "n_chars", [0.25, 0.5]))


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.canonical_lines(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.sha256(t.escaped(F.col("html"))).alias("escaped"))


def padded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.padded("row_", F.col("p_partkey"), 6).alias("id"), t.code_point(F.substring("p_name", 1, 1)).alias("code"))


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second path is absolute; the working folder holds every fifth page."""
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/data/"), F.col("page_id").cast("string"))).otherwise(F.col("page_id").cast("string"))
    pages = table(spark, sf_dir, "pages")
    listing = pages.filter("page_id % 5 = 0").select(F.col("page_id").cast("string").alias("path"))
    return alignment.resolve_paths(pages.select("page_id", path.alias("path")), "path", "/base/", listing, "/work/").select("page_id", "path")


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("side")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return files.union_by_name(a, b).groupBy("nation", "side").agg(F.count("*").alias("n"))


def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.union(b).distinct()


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("text").alias("texts"), F.sum("n_chars").alias("characters"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        text_normalised, script_slices, symbol_counts, line_counts, granularity_violations, core_row_violations, enum_violations, addon_violations, unsafe_paths, id_dups, content_hash_dups, split_overlap,
        bench_overlap, key_differences, unexpected_chars, alphabet_coverage, pair_integrity, count_mismatches, pair_bank_violations, class_key, attenuation_lookup, hist_single, hist_composite, hist_nested,
        hist_two_level, hist_zero_filled, hist_conditional, events_by, distinct_counts, percentiles, canonical_json, html_escape, padded_ids, resolved_paths, union_sources, distinct_union, manifest,
    )
}

# -- SQL -----------------------------------------------------------------------------------------------------------

_WS = "[\\s\\x1c-\\x1f\\x{85}\\p{Z}]"
_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
_LINES = f"(CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(regexp_replace(text, '{_ENDS}', chr(10), 'g'), '\\n\\z', ''), chr(10))) END)"
_MARKS = f"(length(text) - length(translate(text, '{MARKS}', '')))"
_NATIONS = """SELECT n_nationkey, r_name || '|' || CASE WHEN n_nationkey % 2 = 0 THEN 'a -> tone_sensor' ELSE 'b -> tone_sensor' END || '|' || CASE WHEN n_nationkey % 3 = 0 THEN 'ink' ELSE 'none' END AS class_key
FROM nation JOIN region ON n_regionkey = r_regionkey"""
_K27 = "substr('abcdefghijklmnopqrstuvwxyz#', ({}) % 27 + 1, 1)"

ORACLES: dict[str, str] = {
    "text_normalised": f"SELECT doc_id, sha256(regexp_replace(text, '{_WS}', '', 'g')) AS ws, sha256(regexp_replace(nfc_normalize(text), '{_WS}', '', 'g')) AS nfc FROM documents",
    "script_slices": f"SELECT doc_id, sha256(regexp_replace(text, '[^{FIRST}]', '', 'g')) AS first, sha256(regexp_replace(text, '[^\\x{{00C0}}-\\x{{024F}}]', '', 'g')) AS second, sha256(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^{FIRST}]', '', 'g')) AS n_first FROM documents",
    "symbol_counts": f"SELECT doc_id, {_MARKS} AS n, regexp_matches(text, '[A-Za-z]') AS has_letter, contains(text, '***') OR contains(text, '&&&') AS has_noise FROM documents",
    "line_counts": f"SELECT doc_id, {_LINES}::BIGINT AS n_lines FROM documents",
    "granularity_violations": f"""WITH r AS (SELECT doc_id, ['line', 'region', 'page', 'other'][doc_id % 4 + 1] AS g, {_LINES} AS n FROM documents)
SELECT doc_id, CASE WHEN g = 'other' THEN 'unknown granularity' WHEN g = 'line' AND n <> 1 THEN 'line target' WHEN g = 'region' AND n < 3 THEN 'region target' WHEN g = 'page' AND n <> 5 THEN 'page target' END AS violation FROM r WHERE violation IS NOT NULL""",
    "core_row_violations": """WITH r AS (SELECT event_id AS k, CASE WHEN event_id % 11 = 0 THEN 'clear_print' WHEN event_id % 3 = 0 THEN 'heavy' ELSE 'light' END AS profile,
  CASE WHEN event_id % 22 = 0 THEN [] WHEN event_id % 3 = 0 THEN ['ink', 'blur', 'tone_sensor'] WHEN event_id % 7 = 0 THEN ['gamma'] ELSE ['blur', 'tone_sensor'] END AS ops,
  CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN 'spread_minfilter' END AS ink, event_id % 3 = 0 AS applied, CASE WHEN event_id % 3 = 0 THEN 0.8 ELSE 1.0 END AS strength FROM events),
v AS (SELECT k AS id, CASE WHEN list_contains(ops, 'gamma') THEN 'banned operation' WHEN profile = 'clear_print' AND len(ops) > 0 THEN 'clear row is degraded' WHEN profile = 'clear_print' THEN NULL
  WHEN len(list_filter(ops, lambda o: o <> 'tone_sensor')) <> CASE WHEN profile = 'heavy' THEN 2 ELSE 1 END OR coalesce(ops[-1], '') <> 'tone_sensor' THEN 'operation budget'
  WHEN list_contains(ops, 'ink') AND ink IS NULL THEN 'ink mode unknown' WHEN NOT list_contains(ops, 'ink') AND ink IS NOT NULL THEN 'ink mode without ink'
  WHEN NOT (profile = 'heavy' AND ops = ['ink', 'blur', 'tone_sensor'] AND ink IS NOT NULL) AND (applied OR strength <> 1.0) THEN 'unflagged row altered' END AS violation FROM r)
SELECT id, violation FROM v WHERE violation IS NOT NULL""",
    "enum_violations": "SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'fr', 'de')",
    "addon_violations": "SELECT doc_id, lang AS family FROM documents WHERE doc_id % 3 = 2",
    "unsafe_paths": "SELECT page_id, CASE WHEN page_id % 10 = 2 THEN 'duplicate path' ELSE 'unsafe path' END AS violation FROM pages WHERE page_id % 10 IN (0, 1) OR (page_id % 10 = 2 AND (SELECT count(*) FROM pages WHERE page_id % 10 = 2) > 1)",
    "id_dups": "SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "content_hash_dups": "SELECT sha256(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "split_overlap": "SELECT sha256(text) AS digest FROM documents WHERE doc_id % 10 > 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0",
    "bench_overlap": "SELECT sha256(unnest(string_split(text, chr(10)))) AS digest FROM documents INTERSECT SELECT sha256(unnest(string_split(text, chr(10)))) FROM benchmark",
    "key_differences": "SELECT DISTINCT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "unexpected_chars": "SELECT doc_id, string_agg(c, '' ORDER BY unicode(c)) AS unexpected FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^a-zA-Z .,\\n]')) AS c FROM documents) GROUP BY doc_id",
    "alphabet_coverage": f"SELECT s AS symbol FROM (SELECT unnest(string_split('{ALPHABET}', '')) AS s) WHERE s <> '' AND NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'fr' AND contains(text, s))",
    "pair_integrity": """WITH g AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(DISTINCT length(role)) AS s, count(DISTINCT sha256(text)) AS d FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN n <> 2 OR u <> 1 OR a <> 1 THEN 'roles' WHEN s <> 1 THEN 'same differs' WHEN d <> 2 THEN 'digest agrees' END AS violation FROM g WHERE violation IS NOT NULL""",
    "count_mismatches": "WITH e AS (SELECT 'src' || i AS key, 50 AS expected FROM range(22) t(i)), a AS (SELECT source AS key, count(*) AS actual FROM documents GROUP BY 1) SELECT key, coalesce(expected, 0)::BIGINT AS expected, coalesce(actual, 0)::BIGINT AS actual FROM e FULL JOIN a USING (key) WHERE coalesce(expected, 0) <> coalesce(actual, 0)",
    "pair_bank_violations": f"""WITH b AS (SELECT {_K27.format("s_suppkey")} AS a, {_K27.format("s_suppkey * 7 + 3")} AS b, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE 'tone_arc' END AS source FROM supplier), c AS (SELECT *, count(*) OVER (PARTITION BY a, b) AS n FROM b)
SELECT a, b, CASE WHEN a >= b THEN 'order' WHEN n > 1 THEN 'repeated' WHEN a = '#' OR b = '#' THEN 'alphabet' WHEN source = 'unknown' THEN 'source' END AS violation FROM c WHERE violation IS NOT NULL""",
    "class_key": _NATIONS,
    "attenuation_lookup": f"SELECT n_nationkey, class_key, CASE class_key WHEN 'AFRICA|a -> tone_sensor|none' THEN 0.25::DOUBLE WHEN 'ASIA|b -> tone_sensor|ink' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS strength, class_key IN ('AFRICA|a -> tone_sensor|none', 'ASIA|b -> tone_sensor|ink') AS applied FROM ({_NATIONS})",
    "hist_single": "SELECT coalesce(lang, '') AS key, count(*) AS n FROM documents GROUP BY 1",
    "hist_composite": "SELECT coalesce(lang, '') || '/' || coalesce(source, '') AS key, count(*) AS n FROM documents GROUP BY 1",
    "hist_nested": f"""WITH x AS (SELECT 'mark' AS histogram, unnest(regexp_extract_all(text, '[{MARKS}]')) AS key FROM documents UNION ALL SELECT 'lang', lang FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'digit', unnest(regexp_extract_all(text, '[0-9]')) FROM documents)
SELECT histogram, key, count(*) AS n FROM x GROUP BY 1, 2""",
    "hist_two_level": """WITH r AS (SELECT event_type, user_id % 3 AS font, coalesce((json_extract(props, '$.k')::INT % 4)::VARCHAR, '') AS place FROM events)
SELECT 'event_type' AS histogram, event_type AS key, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'font', font::VARCHAR, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'place', place, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'event_typexfont', event_type || '|' || font, count(*) FROM r GROUP BY 2""",
    "hist_zero_filled": "WITH s AS (SELECT unnest(['a', 'b', 'c', '0', '1', '9', '#', '%', 'é', '~']) AS symbol) SELECT symbol, (SELECT coalesce(sum(length(text) - length(replace(text, symbol, ''))), 0) FROM documents)::BIGINT AS n FROM s",
    "hist_conditional": f"SELECT count(*) FILTER ({_MARKS} > 0) AS with_symbol, count(*) FILTER ({_MARKS} = 0) AS without_symbol, count(*) FILTER (n_chars > 5000) AS long_rows, sum({_MARKS})::BIGINT AS symbol_characters FROM documents",
    "events_by": "SELECT lang, sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS n FROM documents GROUP BY lang",
    "distinct_counts": "SELECT count(DISTINCT doc_id) AS doc_id, count(DISTINCT text) AS text, count(DISTINCT source) AS source FROM documents",
    "percentiles": "SELECT quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50 FROM documents",
    "canonical_json": """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""",
    "html_escape": """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""",
    "padded_ids": "SELECT p_partkey, 'row_' || lpad(p_partkey::VARCHAR, 6, '0') AS id, 'U+' || lpad(upper(to_hex(unicode(p_name[1]))), 4, '0') AS code FROM part",
    "resolved_paths": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/data/' || page_id WHEN page_id % 5 = 0 THEN '/work/' || page_id ELSE '/base/' || page_id END AS path FROM pages",
    "union_sources": "SELECT c_nationkey AS nation, 'c' AS side, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, NULL, count(*) FROM supplier GROUP BY 1",
    "distinct_union": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "manifest": "SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, count(DISTINCT text) AS texts, sum(n_chars)::BIGINT AS characters, count(DISTINCT source) AS sources, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents",
}

"""Similarity-graph queries: an embedding stands in for a glyph; font = vec_id % 4, char = vec_id div 4, views are its four quarters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.numeric import cosine
from glyphmill.operators import alignment, similarity
from glyphmill.plans.evaluation import rounded, table

Query = Callable[[SparkSession, str], DataFrame]

K, FONTS, VIEWS, VIEW_SHARE, CLEAN, CLEAN_EVERY = 6, 2, 4, 0.75, 2, 2


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 4).cast("int").alias("font"), F.lit(0).alias("view"), F.floor(F.col("vec_id") / 4).cast("long").alias("i"), F.col("embedding").alias("feature"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = whole(spark, sf_dir).drop("view").withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(VIEWS - 1))))
    return w.withColumn("feature", F.slice("feature", F.col("view") * 16 + 1, F.lit(16)))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.candidate_pairs(whole(spark, sf_dir), views(spark, sf_dir), K, FONTS, VIEWS, VIEW_SHARE, CLEAN, CLEAN_EVERY)


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).filter("font_support >= 3").select("a", "b")


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar function: every vector with the next one by id. Pairs within a font are sim_ranks, over the table top_cosines."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("sim"))


def sim_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.neighbours(whole(spark, sf_dir), K).select("font", "i", "j", "sim", F.col("rank").cast("long").alias("rank")), 6)


def mutual_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.mutual_edges(similarity.neighbours(whole(spark, sf_dir), K)).select("font", "i", "j", "sim"), 6)


def edge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.view_support(similarity.mutual_edges(similarity.neighbours(views(spark, sf_dir), K)), CLEAN_EVERY)


def stable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.stable_edges(whole(spark, sf_dir), K, FONTS), 6)


def candidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).orderBy(*similarity.candidate_order()).withColumn("stable_fonts", F.array_join(F.col("stable_fonts").cast("array<string>"), ","))
    return rounded(rows.withColumn("median_mutual_rank", F.col("median_mutual_rank").cast("double")), 6)


def pair_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a further 0 first, then the candidates of the similarity graph."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").cast("long").alias("value"))
    suffixed = alignment.suffix_pairs(names, "name", "value", "0").select("a", "b", F.greatest("a", "b").cast("string").alias("name"))
    bank = similarity.pair_bank(suffixed, _candidates(spark, sf_dir)).drop("stable_fonts")
    return rounded(bank.withColumn("median_mutual_rank", F.col("median_mutual_rank").cast("double")), 6)


def vertex_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.degrees(similarity.stable_edges(whole(spark, sf_dir), K, FONTS))


def coverage_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.coverage_floor(similarity.stable_edges(whole(spark, sf_dir), K, FONTS), _accepted(spark, sf_dir)), 6)


def top_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's three nearest over the whole table."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    return rounded(similarity.cosine_pairs(e, "vec_id", "embedding", 3).select("i", "j", "sim", F.col("rank").cast("long").alias("rank")), 6)


def suffix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as names: a name and the name with a further 0."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("value"))
    return alignment.suffix_pairs(names, "name", "value", "0")


def pair_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    base = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a"), F.lit("tone_arc").alias("source"))
    new = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("a"), F.lit("cluster_multifont").alias("source"), F.col("p_size").alias("score"))
    return alignment.upsert(base, new, ["a"], ["score"])


def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.top_per_group(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", [F.desc("p_size"), F.col("p_partkey")], 8)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (cosine_pairs, top_cosines, sim_ranks, mutual_topk, edge_support, stable_edges, candidate_edges, pair_bank, vertex_degree, coverage_floor, suffix_pairs, pair_upsert, top_per_group)
}

_F = """WITH feats AS (SELECT vec_id % 4 AS font, vec_id // 4 AS i, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings),
sims AS (SELECT a.font, a.i, b.i AS j, list_cosine_similarity(a.f, b.f) AS sim FROM feats a JOIN feats b ON a.font = b.font AND a.i <> b.i),
ranks AS (SELECT *, row_number() OVER (PARTITION BY font, i ORDER BY sim DESC, j) AS rank FROM sims),
mutual AS (SELECT x.font, x.i, x.j, x.sim, greatest(x.rank, y.rank) AS mr FROM ranks x JOIN ranks y ON x.font = y.font AND x.i = y.j AND x.j = y.i WHERE x.i < x.j),
stable AS (SELECT i, j, count(*) AS font_support, median(sim) AS median_similarity FROM mutual WHERE mr <= 6 GROUP BY i, j HAVING count(*) >= 2)"""
_V = """,
vf AS (SELECT font, v, i, f[16 * v + 1 : 16 * v + 16] AS f FROM feats CROSS JOIN range(4) t(v)),
vs AS (SELECT a.font, a.v, a.i, b.i AS j, row_number() OVER (PARTITION BY a.font, a.v, a.i ORDER BY list_cosine_similarity(a.f, b.f) DESC, b.i) AS rank FROM vf a JOIN vf b ON a.font = b.font AND a.v = b.v AND a.i <> b.i),
ve AS (SELECT x.font, x.v, x.i, x.j FROM vs x JOIN vs y ON x.font = y.font AND x.v = y.v AND x.i = y.j AND x.j = y.i WHERE x.i < x.j AND x.rank <= 6 AND y.rank <= 6),
support AS (SELECT font, i, j, count(*) AS views, count(*) FILTER (v % 2 = 0) AS clean FROM ve GROUP BY font, i, j)"""

ORACLES: dict[str, str] = {
    "cosine_pairs": "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "top_cosines": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings WHERE embedding IS NOT NULL)
SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.f, b.f), 6) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.f, b.f) DESC, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id QUALIFY rank <= 3""",
    "sim_ranks": f"{_F} SELECT font::INT AS font, i, j, round(sim, 6) AS sim, rank FROM ranks WHERE rank <= 6",
    "mutual_topk": f"""{_F} SELECT font::INT AS font, least(i, j) AS i, greatest(i, j) AS j, round(max(sim), 6) AS sim FROM ranks WHERE rank <= 6 GROUP BY font, least(i, j), greatest(i, j) HAVING count(*) = 2""",
    "coverage_floor": f"""{_F.replace("WITH feats", "WITH RECURSIVE feats", 1)}{_V}, sp AS (SELECT * FROM support WHERE views >= 3 AND clean >= 2), c AS (SELECT i, j FROM stable UNION SELECT i, j FROM sp),
accepted AS (SELECT i, j FROM c JOIN mutual m USING (i, j) GROUP BY i, j HAVING count(*) FILTER (mr <= 6) >= 3),
covered AS (SELECT unnest([i, j]) AS v FROM stable SEMI JOIN accepted USING (i, j)),
open AS (SELECT DISTINCT v FROM (SELECT unnest([i, j]) AS v FROM stable) WHERE v NOT IN (SELECT v FROM covered)),
ranked AS (SELECT *, i IN (SELECT v FROM open) AS oi, j IN (SELECT v FROM open) AS oj, row_number() OVER (ORDER BY font_support DESC, median_similarity DESC, i, j) AS n FROM stable),
lists AS (SELECT list(i ORDER BY n) AS li, list(j ORDER BY n) AS lj, count(*) AS total FROM ranked WHERE oi AND oj),
greedy AS (SELECT 0 AS k, []::BIGINT[] AS used, []::BIGINT[] AS won
  UNION ALL SELECT k + 1, CASE WHEN list_contains(used, li[k + 1]) OR list_contains(used, lj[k + 1]) THEN used ELSE used || [li[k + 1], lj[k + 1]] END,
    CASE WHEN list_contains(used, li[k + 1]) OR list_contains(used, lj[k + 1]) THEN won ELSE won || [k + 1] END FROM greedy, lists WHERE k < total),
done AS (SELECT used, won FROM greedy ORDER BY k DESC LIMIT 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY n) AS m FROM ranked WHERE oi AND oj),
lone AS (SELECT * FROM (SELECT r.*, unnest([i, j]) AS v FROM ranked r) WHERE v IN (SELECT v FROM open) AND NOT list_contains((SELECT used FROM done), v) QUALIFY row_number() OVER (PARTITION BY v ORDER BY n) = 1)
SELECT i AS a, j AS b, font_support, round(median_similarity, 6) AS median_similarity FROM numbered WHERE list_contains((SELECT won FROM done), m)
UNION ALL SELECT i, j, font_support, round(median_similarity, 6) FROM lone""",
    "edge_support": f"{_F}{_V} SELECT font::INT AS font, i, j, views, clean FROM support",
    "stable_edges": f"{_F} SELECT i, j, font_support, round(median_similarity, 6) AS median_similarity FROM stable",
    "candidate_edges": f"""{_F}{_V}, sp AS (SELECT * FROM support WHERE views >= 3 AND clean >= 2), c AS (SELECT i, j FROM stable UNION SELECT i, j FROM sp),
e AS (SELECT m.*, sp.views, sp.clean FROM c JOIN mutual m USING (i, j) LEFT JOIN sp ON sp.i = m.i AND sp.j = m.j AND sp.font = m.font)
SELECT i AS a, j AS b, CASE WHEN count(*) FILTER (mr <= 6) >= 2 THEN 'cluster_multifont' ELSE 'cluster_font_specific' END AS source, round(median(sim), 6) AS score, count(*) FILTER (mr <= 6) AS font_support, median(mr)::DOUBLE AS median_mutual_rank,
  round(min(sim), 6) AS font_min_score, round(max(sim), 6) AS font_max_score, coalesce(string_agg(CASE WHEN views IS NOT NULL THEN font::VARCHAR END, ',' ORDER BY font), '') AS stable_fonts, coalesce(max(views), 0) AS max_view_support, coalesce(max(clean), 0) AS max_clean_size_support
FROM e GROUP BY i, j""",
    "pair_bank": f"""{_F}{_V}, sp AS (SELECT * FROM support WHERE views >= 3 AND clean >= 2), c AS (SELECT i, j FROM stable UNION SELECT i, j FROM sp),
e AS (SELECT m.*, sp.views, sp.clean FROM c JOIN mutual m USING (i, j) LEFT JOIN sp ON sp.i = m.i AND sp.j = m.j AND sp.font = m.font),
found AS (SELECT i AS a, j AS b, CASE WHEN count(*) FILTER (mr <= 6) >= 2 THEN 'cluster_multifont' ELSE 'cluster_font_specific' END AS cs, median(sim) AS score, count(*) FILTER (mr <= 6) AS font_support, median(mr)::DOUBLE AS median_mutual_rank,
  min(sim) AS font_min_score, max(sim) AS font_max_score, coalesce(max(views), 0) AS max_view_support, coalesce(max(clean), 0) AS max_clean_size_support FROM e GROUP BY i, j),
arcs AS (SELECT DISTINCT least(a.p_partkey, b.p_partkey) AS a, greatest(a.p_partkey, b.p_partkey) AS b FROM part a JOIN part b ON b.p_partkey::VARCHAR = a.p_partkey::VARCHAR || '0' WHERE a.p_partkey <> b.p_partkey),
bank AS (SELECT coalesce(x.a, f.a) AS a, coalesce(x.b, f.b) AS b, x.a IS NOT NULL AS arc, f.* EXCLUDE (a, b) FROM arcs x FULL JOIN found f ON x.a = f.a AND x.b = f.b)
SELECT row_number() OVER (ORDER BY NOT arc, CASE WHEN arc THEN b::VARCHAR END, cs <> 'cluster_multifont', font_support DESC, median_mutual_rank, round(score, 4) DESC, a, b) - 1 AS position, a, b, CASE WHEN arc THEN 'tone_arc' ELSE cs END AS source, CASE WHEN arc THEN cs END AS cluster_source,
  round(score, 6) AS score, font_support, median_mutual_rank, round(font_min_score, 6) AS font_min_score, round(font_max_score, 6) AS font_max_score, max_view_support, max_clean_size_support FROM bank""",
    "vertex_degree": f"{_F} SELECT vertex, count(*) AS degree FROM (SELECT i AS vertex FROM stable UNION ALL SELECT j FROM stable) GROUP BY vertex",
    "suffix_pairs": "SELECT DISTINCT least('c' || a.p_partkey, 'c' || b.p_partkey) AS a, greatest('c' || a.p_partkey, 'c' || b.p_partkey) AS b, 'suffix' AS source FROM part a JOIN part b ON b.p_partkey::VARCHAR = a.p_partkey::VARCHAR || '0'",
    "pair_upsert": "WITH b AS (SELECT p_partkey AS a FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey AS a, p_size AS score FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(b.a, n.a) AS a, CASE WHEN b.a IS NOT NULL THEN 'tone_arc' ELSE 'cluster_multifont' END AS source, CASE WHEN b.a IS NOT NULL AND n.a IS NOT NULL THEN 'cluster_multifont' END AS cluster_source, score FROM b FULL JOIN n ON b.a = n.a",
    "top_per_group": "SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 8",
}

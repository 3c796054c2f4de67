"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import assign_secrets, bestfit_pack, byte_fim, byte_gru, curriculum_mix, hnsw_dedup, html_diff, importance_resample, pcy_phrases, pii_disclosure, reply_trees, simhash_vp, voronoi_topk
from glyphmill.llm._common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_html_diff": lambda s, d: html_diff.op1_html_diff(table(s, d, "pages")),
    "op2_pii_disclosure": lambda s, d: pii_disclosure.op2_pii_disclosure(table(s, d, "documents")),
    "op3_curriculum_mix": lambda s, d: curriculum_mix.op3_curriculum_mix(table(s, d, "documents")),
    "op4_hnsw_dedup": lambda s, d: hnsw_dedup.op4_hnsw_dedup(table(s, d, "embeddings")),
    "op5_byte_gru": lambda s, d: byte_gru.op5_byte_gru(table(s, d, "documents")),
    "op6_bestfit_pack": lambda s, d: bestfit_pack.op6_bestfit_pack(table(s, d, "documents")),
    "op7_voronoi_topk": lambda s, d: voronoi_topk.op7_voronoi_topk(table(s, d, "embeddings")),
    "op8_importance_resample": lambda s, d: importance_resample.op8_importance_resample(table(s, d, "documents"), table(s, d, "labels")),
    "op9_assign_secrets": lambda s, d: assign_secrets.op9_assign_secrets(table(s, d, "documents")),
    "op10_simhash_vp": lambda s, d: simhash_vp.op10_simhash_vp(table(s, d, "documents")),
    "op11_pcy_phrases": lambda s, d: pcy_phrases.op11_pcy_phrases(table(s, d, "documents")),
    "op12_reply_trees": lambda s, d: reply_trees.op12_reply_trees(table(s, d, "conversations")),
    "op13_byte_fim": lambda s, d: byte_fim.op13_byte_fim(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op3_curriculum_mix": curriculum_mix.SQL,
    "op4_hnsw_dedup": hnsw_dedup.SQL,
    "op7_voronoi_topk": voronoi_topk.SQL,
    "op11_pcy_phrases": pcy_phrases.SQL,
    "op12_reply_trees": reply_trees.SQL,
    "op13_byte_fim": byte_fim.SQL,
}

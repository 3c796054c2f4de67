"""Corpus pipeline: stages over documents (counted as part of the subpackage llm).

Every stage takes all rows that the one before it kept. Null texts count as empty. Such rows pass the quality stage by the
threshold like any other; all empty texts are one group of near-duplicates, of which one document stays; an empty document
has no words, so the mixture takes none of it. Rows repeated whole stay or go together in the quality stage and end in one
row in the next. Null doc_ids and sources are values like any other (a group of near-duplicates keeps one, if it has no
other; a null source is a source of its own). Further columns are carried through to the mixture, whatever their names;
packing returns its own columns. An empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import assign_secrets, bestfit_pack, curriculum_mix, importance_resample, simhash_vp
from glyphmill.llm._common import materialise, table
from glyphmill.session import drop_scratch, noted_scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the importance resampling keeps."""
    return importance_resample.resample(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id's."""
    return simhash_vp.simhash_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return assign_secrets.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order."""
    return curriculum_mix.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their bins."""
    return bestfit_pack.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: SQL can't express the network of n-gram models or the fingerprints' hash; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. A stage's scratch tables go when its result is written, and its result goes when
    the next one's is; what the last stage reads stays, as its rows are yet to be read."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with noted_scratch() as made:
            result = stage(spark, docs, sf_dir)
            helpers = list(made)
            docs = materialise(result, name)
        drop_scratch(spark, read + helpers)
        read = made[len(helpers) :]
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline over ``documents``: drop toxic texts, exact copies, near copies and
benchmark leaks, then encode what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns they were given. ``labels`` and ``benchmark`` are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveyspark.llm import bpe, common, decontaminate, exact_dedup, near_dedup, toxicity


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5."""
    model = toxicity.fit_on_labels(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.deduplicate(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the document with the smallest id."""
    return near_dedup.deduplicate(docs, words=5, percent=80)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.op3_bpe(spark, sf_dir, docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact dedup", stage_exact_dedup),
    ("near dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("bpe", stage_bpe),
]

# The classifier of the first stage has no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    last = len(STAGES) - 1
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < last:
            docs = common.written(docs, name.replace(" ", "-"))
    return docs

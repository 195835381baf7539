"""Corpus pipeline: stages over the documents table, each written as parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, line_dedup, quality_crf, sentencepiece_tokens, simhash
from tidemark.runtime import materialize, table

STAGES = [
    ("quality_classifier", quality_crf.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("sentencepiece", sentencepiece_tokens.stage),
]
#: The stages train models and decide by fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table."""
    docs = table(spark, sf_dir, "documents", spread=True)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Search-quality query sets: JSON lines with a query and its matchers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metrics import MATCHER_KEYS

SCHEMA = f"query string, relevant array<struct<{', '.join(k + ':string' for k in MATCHER_KEYS)}>>, note string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The queries of a JSONL file. A line without query or matchers, or a matcher without any known
    key (it would fit everything), is an error."""
    rows = spark.read.schema(SCHEMA).json(path)
    empty = F.exists("relevant", lambda m: ~(m["repo"].isNotNull() | m["path_prefix"].isNotNull() | m["breadcrumb_substring"].isNotNull()))
    bad = rows.filter(F.col("query").isNull() | F.col("relevant").isNull() | empty).select("query").take(1)
    if bad:
        raise ValueError(f"query {bad[0]['query']!r}: each matcher needs one of {', '.join(MATCHER_KEYS)}")
    return rows

"""Schemas and domains of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()
MAP = T.MapType(S, S)
VECTOR = T.ArrayType(T.FloatType())
TSVECTOR = T.ArrayType(T.StructType([T.StructField("lexeme", S), T.StructField("positions", T.ArrayType(I))]))

SOURCE_TYPES = ("git_repo", "jira_project", "drive_folder")
SOURCE_ALIASES = {"git": "git_repo", "jira": "jira_project", "drive": "drive_folder"}
DOMAINS = {
    "source_type": SOURCE_TYPES,
    "policy": ("allow", "deny"),
    "parse_status": ("ok", "heuristic_fallback", "crashed_fallback"),
    "secrets_status": ("clean", "redacted"),
}
DIMENSIONS = 384


def _struct(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in columns])


SOURCES = _struct(("id", S, False), ("source_type", S, False), ("name", S, False), ("identifier", S, False), ("policy", S, False), ("active", B, False), ("config", MAP, False), ("inserted_at", TS, False), ("updated_at", TS, False))
CHUNKS = _struct(
    ("id", S, False), ("source_id", S, False), ("source_type", S, False), ("repo", S, True), ("lang", S, True), ("chunk_key", S, False), ("content_hash", S, True), ("content", S, False), ("context_breadcrumb", S, False),
    ("metadata", MAP, True), ("embedding", VECTOR, True), ("tsv", TSVECTOR, True), ("parse_status", S, False), ("secrets_status", S, False), ("inserted_at", TS, True), ("updated_at", TS, True),
)
RAW_FILES = _struct(("source_id", S, False), ("source_type", S, False), ("repo", S, True), ("lang", S, True), ("natural_key", S, False), ("content_hash", S, True), ("raw_content", S, True), ("metadata", MAP, True))
SYNC_STATES = _struct(("source_id", S, False), ("cursor", MAP, False), ("status", S, False), ("last_synced_at", TS, True))
SPAN = _struct(("start", I, False), ("length", I, False))
SECRET_FINDINGS = _struct(("source_id", S, True), ("chunk_id", S, True), ("file_reference", S, True), ("detector", S, False), ("rule_id", S, False), ("secret_type", S, False), ("span", SPAN, False), ("match_hash", S, False), ("action", S, False), ("detected_at", TS, False))
CHUNK_ITEM = _struct(("text", S, False), ("breadcrumb", S, False), ("start_line", I, False), ("end_line", I, False), ("kind", S, False), ("parse_status", S, False))
FINDING = _struct(("detector", S, False), ("rule_id", S, False), ("secret_type", S, False), ("start", I, False), ("length", I, False), ("match", S, False))


def check_domains(df: DataFrame) -> DataFrame:
    """df, failing at run time on a value outside its column's domain (null counts as outside)."""
    for name, allowed in DOMAINS.items():
        if name in df.columns:
            fine = F.coalesce(F.col(name).isin(*allowed), F.lit(False))
            df = df.withColumn(name, F.when(fine, F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"{name} is outside its domain: "), F.coalesce(F.col(name), F.lit("null")))).cast("string")))
    return df


def mirror_slug(config: Column, name: Column) -> Column:
    """A source's repository slug: what its config says, else its name."""
    return F.coalesce(config["mirror_slug"], name)

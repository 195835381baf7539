"""Issue tracker responses: one JSON document a row, in a string column `body`."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar
from tidemark.sources import http

RESOLVED = ("Resolved", "Closed", "Done")
_BODY = "issues array<struct<key:string, fields:struct<summary:string, description:string, status:struct<name:string>, resolutiondate:string>>>"


def jql(project: str, since: str | None) -> str:
    """The search that a live fetch would send; the date bound is inclusive."""
    bound = f' AND resolutiondate >= "{since}"' if since else ""
    return f'project = "{project}" AND status in ({", ".join(RESOLVED)}){bound} ORDER BY resolutiondate ASC'


def fetch(spark: SparkSession, get: http.Get, project: str, since: str | None, page: int = 50) -> DataFrame:
    """Search answers (body) of resolved issues since a watermark, page by page, by a client
    get(path, params) that is handed in. A limit on requests ends it with http.Snooze."""
    bodies, start = [], 0
    while True:
        found = http.body(get("/rest/api/3/search", {"jql": jql(project, since), "startAt": start, "maxResults": page}))
        bodies.append((json.dumps(found),))
        got = len(found.get("issues") or [])
        start += got
        if not got or start >= found.get("total", start):
            return spark.createDataFrame(bodies, "body string")


def adf_text(node: object) -> str:
    """Text of a rich-text tree: text nodes in order, hard breaks as newlines, all else nothing."""
    if isinstance(node, str):
        return node
    if not isinstance(node, dict):
        return ""
    if node.get("type") == "text":
        return node.get("text") or ""
    if node.get("type") == "hardBreak":
        return "\n"
    content = node.get("content")
    return "".join(adf_text(x) for x in content) if isinstance(content, list) else ""


@F.pandas_udf(T.StringType())
def adf_udf(description: pd.Series) -> pd.Series:
    def text(raw: str | None) -> str:
        if raw is None:
            return ""
        try:
            return adf_text(json.loads(raw)) if raw.lstrip()[:1] in ('{', '"') else raw
        except ValueError:
            return raw

    return description.map(text)


def parse_issues(bodies: DataFrame) -> DataFrame:
    """(key, text, resolutiondate) of all issues in the bodies; the text is summary and description
    with a blank line between, without blank parts; the date stays a string."""
    rows = bodies.select(F.from_json("body", _BODY).alias("b")).select(F.inline("b.issues"))
    parts = F.array(F.col("fields.summary"), adf_udf("fields.description"))
    text = F.array_join(F.filter(parts, lambda p: p.isNotNull() & ~scalar.is_blank(p)), "\n\n")
    return rows.select("key", text.alias("text"), F.col("fields.resolutiondate").alias("resolutiondate"))


def resolved_since(issues: DataFrame, since: str | None) -> DataFrame:
    """What the search returns, from a dump issues(key, status, resolutiondate, ...): all pages."""
    out = issues.filter(F.col("status").isin(*RESOLVED))
    return (out if since is None else out.filter(F.col("resolutiondate") >= since)).orderBy("resolutiondate")


def raw_rows(issues: DataFrame, source_id: str | Column) -> DataFrame:
    """Raw rows of parsed issues."""
    return issues.select(
        (source_id if isinstance(source_id, Column) else F.lit(source_id)).alias("source_id"), F.lit("jira_project").alias("source_type"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("lang"),
        scalar.natural_key("jira", F.col("key")).alias("natural_key"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("raw_content"),
        F.create_map(F.lit("issue_key"), F.col("key"), F.lit("resolutiondate"), F.col("resolutiondate")).alias("metadata"),
    )

"""Document store change feeds: one JSON response a row, in a string column `body`."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.sources import http

DOCUMENT = "application/vnd.google-apps.document"
_BODY = "newStartPageToken string, changes array<struct<fileId:string, removed:boolean, file:struct<id:string, name:string, mimeType:string>>>"


def parse_changes(bodies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(removed ids, documents (id, name), cursor): a change is a removal if it says so or names no
    file; other changes count only for text documents. Of one file the last change counts where
    bodies have a column `page`. The cursor is the token of the last page that has one, null if none;
    tokens are opaque, and where no column says which page is last, the longest and then greatest
    counts, as tokens that count up need."""
    ordered = "page" in bodies.columns
    parsed = bodies.select(F.from_json("body", _BODY).alias("b"), (F.col("page").cast("long") if ordered else F.lit(0)).alias("page"))
    changes = parsed.select("page", F.posexplode("b.changes").alias("pos", "c")).select("page", "pos", "c.*")
    if ordered:
        last = Window.partitionBy("fileId").orderBy(F.desc("page"), F.desc("pos"))
        changes = changes.withColumn("n", F.row_number().over(last)).filter("n = 1")
    gone = F.coalesce("removed", F.lit(False)) | F.col("file").isNull()
    removed = changes.filter(gone).select(F.col("fileId").alias("id")).distinct()
    docs = changes.filter(~gone & (F.col("file.mimeType") == DOCUMENT)).select("file.id", "file.name")
    return removed, docs, parsed.filter("b.newStartPageToken is not null").agg(F.max_by("b.newStartPageToken", F.struct("page", F.length("b.newStartPageToken"), "b.newStartPageToken")).alias("cursor"))


def fetch(spark: SparkSession, get: http.Get, cursor: str | None) -> DataFrame:
    """Change pages (page, body) since a cursor, by a client get(path, params) that is handed in.
    Without a cursor one start token is fetched and there are no changes yet."""
    if cursor is None:
        token = http.body(get("/changes/startPageToken", {}))["startPageToken"]
        return spark.createDataFrame([(0, json.dumps({"newStartPageToken": token, "changes": []}))], "page long, body string")
    pages, token = [], cursor
    while token is not None:
        found = http.body(get("/changes", {"pageToken": token, "includeRemoved": "true"}))
        pages.append((len(pages), json.dumps(found)))
        token = found.get("nextPageToken")
    return spark.createDataFrame(pages, "page long, body string")


def fetch_exports(docs: DataFrame, get: http.Get) -> DataFrame:
    """exports(id, content, error) of documents, each fetched in a task; a failure is a row with its
    error, so that the others still count. A limit on requests (http.Snooze) is one such error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"]:
                try:
                    out.append((i, http.text(get(export_path(i), {})), None))
                except (http.Failed, http.Snooze) as e:
                    out.append((i, None, str(e)))
            yield pd.DataFrame(out, columns=["id", "content", "error"])

    return docs.select("id").mapInPandas(run, "id string, content string, error string")


def export_path(doc_id: str) -> str:
    """Path of a document's markdown export; the id can't escape its segment."""
    return f"/files/{quote(doc_id, safe='')}/export?mimeType=text%2Fmarkdown"


def exported(docs: DataFrame, exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with content, documents whose export failed): exports(id, content, error). The
    cursor may move only if nothing failed, while what succeeded is staged at once."""
    joined = docs.join(exports, "id", "left")
    fine = F.col("content").isNotNull() & F.col("error").isNull()
    return joined.filter(fine).drop("error"), joined.filter(~fine).select("id", "error")


def raw_rows(docs: DataFrame, source_id: str | Column) -> DataFrame:
    """Raw rows of exported documents (id, name, content)."""
    return docs.select(
        (source_id if isinstance(source_id, Column) else F.lit(source_id)).alias("source_id"), F.lit("drive_folder").alias("source_type"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("lang"),
        scalar.natural_key("drive", F.col("id")).alias("natural_key"), F.sha2("content", 256).alias("content_hash"), F.col("content").alias("raw_content"),
        F.create_map(F.lit("doc_id"), F.col("id"), F.lit("name"), F.col("name")).alias("metadata"),
    )

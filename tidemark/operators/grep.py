"""Exact text: regex search by line and file retrieval over a snapshot table
files(repo, ref, path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar

PER_FILE, TOTAL, TOTAL_BYTES = 100, 500, 1_000_000
TOO_BROAD = {"", ".", ".*", ".+", ".*.*"}


def grep_lines(files: DataFrame, pattern: str, per_file: int | None = PER_FILE, basic: bool = False) -> DataFrame:
    """(repo, path, line, text): lines that match, numbered from 1, the first per_file of each
    file. basic: the pattern is a POSIX basic regular expression. Binary files are skipped; a
    newline at a text's end starts no further line."""
    pattern = scalar.java_regex(pattern) if basic else pattern
    text = F.regexp_replace("content", "\n$", "")
    # the whole-file test costs one pass and keeps most files from being split; with (?m) the ends of
    # lines match as the ends of the text do, so a pattern that finds a line finds its file
    some = files.filter(F.col("content").rlike("(?m)" + pattern))
    lines = some.filter(F.locate("\x00", "content") == 0).select("repo", "path", F.posexplode(F.split(text, "\n")).alias("pos", "text"))
    hits = lines.filter(F.col("text").rlike(pattern)).select("repo", "path", (F.col("pos") + 1).alias("line"), "text")
    if per_file is None:
        return hits
    order = Window.partitionBy("repo", "path").orderBy("line")
    return hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_file).drop("_n")


def grep(files: DataFrame, pattern: str, limit: int = TOTAL, limit_bytes: int = TOTAL_BYTES) -> tuple[list[dict], bool]:
    """(matches, truncated): at most `limit` matches by (repo, path, line), of limit_bytes in all, and
    whether there are more; one more row than the limit is asked for, so the flag is exact. A match
    counts its path, line number and text, and a separator each, in bytes; none is cut."""
    found = grep_lines(files, pattern, basic=True)
    size = F.octet_length("path") + F.length(F.col("line").cast("string")) + F.octet_length("text") + 3
    top = found.orderBy("repo", "path", "line").limit(limit + 1)
    order = Window.orderBy("repo", "path", "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = top.withColumn("_sum", F.sum(size).over(order)).orderBy("repo", "path", "line").select("*", (F.col("_sum") <= limit_bytes).alias("_fits")).drop("_sum")
    # lines beyond the bytes come without their text: the driver never holds more than the budget
    rows = rows.withColumn("text", F.when(F.col("_fits"), F.col("text"))).collect()
    kept = [{k: v for k, v in r.asDict().items() if k != "_fits"} for r in rows[:limit] if r["_fits"]]
    return kept, len(kept) < len(rows)


def get_file(files: DataFrame, repo: str, path: str, ref: str = "HEAD") -> DataFrame:
    """(repo, path, ref, content, too_large) of one file; content is null beyond MAX_FILE_BYTES."""
    hit = files.filter((F.col("repo") == repo) & (F.col("path") == path) & (F.col("ref") == ref))
    large = F.octet_length("content") > scalar.MAX_FILE_BYTES
    return hit.select("repo", "path", "ref", F.when(~large, F.col("content")).alias("content"), large.alias("too_large"))

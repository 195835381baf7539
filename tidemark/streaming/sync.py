"""Incremental sync as a structured stream: micro-batches upsert a versioned chunk table."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import model
from tidemark.operators import ingest, scrub
from tidemark.sources import drive, issues

#: One change a line: of a file (git_repo), an issue (jira_project) or a document (drive_folder).
#: path: the file's path, the issue's key or the document's id; name: the document's name; cursor:
#: where its source stands once the change is in; status: deleted, failed (couldn't be read: what is
#: stored stays, and the source's cursor too) or anything else for a change of content.
FEED = "source_id string, source_type string, repo string, ref string, path string, name string, content string, status string, seq long, cursor string"
CURSOR_KEYS = {"git_repo": "last_sha", "jira_project": "resolutiondate_watermark", "drive_folder": "start_page_token"}
BUCKETS = 256


def origin(chunks: DataFrame) -> Column:
    """What tells the file, issue or document of a chunk, by its metadata."""
    return F.coalesce(*(chunks["metadata"][key] for key in ("path", "issue_key", "doc_id")))


def bucket(source_id: Column, of: Column) -> Column:
    return F.pmod(F.xxhash64(source_id, of), F.lit(BUCKETS)).cast("int")


class VersionedTable:
    """A parquet table in versions under one folder. A version is a manifest: for each bucket the
    version that last wrote it, so a write touches only the buckets that it changes. The manifest
    is written last, so readers see a version entirely or not at all, and the same version can be
    written again after a failure."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [PurePosixPath(s.getPath().toString()).name for s in fs.listStatus(path(self.path))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done"))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """bucket -> version of the newest version, or of the newest below `before`."""
        fit = [v for v in self.versions() if before is None or v < before]
        if not fit:
            return {}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/v{fit[-1]}.done"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (see manifest), of some buckets or of all."""
        held = self.manifest(before)
        paths = [f"{self.path}/v{v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, df: DataFrame, version: int, number: Column, buckets: list[int]) -> None:
        """Version `version`: its predecessor with `buckets` replaced by df, whose rows are in the
        buckets that `number` says."""
        dealt = df.withColumn("bucket", number)
        dealt.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/v{version}")
        fs, path = self._fs()
        held = {b: v for b, v in self.manifest(version).items() if b not in buckets}
        held |= {b: version for b in buckets if fs.exists(path(f"{self.path}/v{version}/bucket={b}"))}
        out = fs.create(path(f"{self.path}/v{version}.done"), True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()

    def vacuum(self, keep: int = 2) -> None:
        """Forget all versions but the newest `keep`, and delete what no other version holds."""
        fs, path = self._fs()
        known = self.versions()
        live = {(b, v) for k in known[-keep:] for b, v in self.manifest(k + 1).items()}
        for v in known[:-keep]:
            fs.delete(path(f"{self.path}/v{v}.done"), False)
        for v in known:
            for s in fs.listStatus(path(f"{self.path}/v{v}")) if fs.exists(path(f"{self.path}/v{v}")) else ():
                name = PurePosixPath(s.getPath().toString()).name
                if name.startswith("bucket=") and (int(name[7:]), v) not in live:
                    fs.delete(s.getPath(), True)


class Store:
    """The tables that a sync keeps under one folder: chunks, sync_states and secret_findings."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.chunks = VersionedTable(spark, f"{root}/chunks", model.CHUNKS)
        self.states = VersionedTable(spark, f"{root}/sync_states", model.SYNC_STATES)
        self.findings = VersionedTable(spark, f"{root}/secret_findings", model.SECRET_FINDINGS)

    def vacuum(self, keep: int = 2) -> None:
        """Old versions of chunks and states go; findings are a log, whose versions all stay."""
        self.chunks.vacuum(keep)
        self.states.vacuum(keep)


def raw_rows(feed: DataFrame) -> DataFrame:
    """Raw rows of a feed's changed content, by source type."""
    kind = lambda name: feed.filter(F.col("source_type") == name)
    git = ingest.raw_rows(kind("git_repo"))
    issue = issues.raw_rows(kind("jira_project").select("source_id", F.col("path").alias("key"), F.col("content").alias("text"), F.col("cursor").alias("resolutiondate")), F.col("source_id"))
    doc = drive.raw_rows(kind("drive_folder").select("source_id", F.col("path").alias("id"), "name", "content"), F.col("source_id"))
    return git.unionByName(issue).unionByName(doc)


def apply_batch(store: Store, feed: DataFrame, batch: int, prune_stale: bool = False) -> None:
    """Version `batch` + 1 of the tables. The last entry of each origin in the feed counts: what is
    deleted is pruned, what failed stays, the rest is scrubbed, chunked, embedded and upserted, in
    the buckets that the feed touches and no others. Scrubbed rows are staged as a table for the
    batch and deleted after it. Findings are written first, then chunks, and cursors last: after a
    failure anywhere the batch comes again and writes the same versions from the same predecessors.
    The cursor of a source with a failed entry doesn't move."""
    spark, version = store.spark, batch + 1
    spread = feed.withColumn("source_type", F.coalesce("source_type", F.lit("git_repo")))
    last = ingest.latest(spread, ["source_id", "path"], F.col("seq")).withColumn("bucket", bucket(F.col("source_id"), F.col("path")))
    staging = f"{store.root}/staging/b{batch}"
    last.write.mode("overwrite").parquet(f"{staging}/feed")
    last = spark.read.schema(last.schema).parquet(f"{staging}/feed")
    touched = [r["bucket"] for r in last.select("bucket").distinct().collect()]  # BUCKETS at most
    changed = last.filter(~F.coalesce(F.col("status"), F.lit("modified")).isin("deleted", "failed"))
    scrubbed = scrub.scrub_rows(raw_rows(changed))
    scrubbed.write.mode("overwrite").parquet(f"{staging}/scrubbed")
    scrubbed = spark.read.schema(scrubbed.schema).parquet(f"{staging}/scrubbed")
    store.findings.write(scrub.audit(scrubbed), version, F.lit(batch), [batch])

    old = store.chunks.read(version, touched)
    old = old.withColumn("path", origin(old))
    gone = last.filter("status = 'deleted'").select(F.col("source_id").alias("_s"), F.col("path").alias("_p"))
    kept = old.join(gone, (old["source_id"] == gone["_s"]) & (old["path"] == gone["_p"]), "left_anti").drop("path")
    fresh = ingest.chunk_table(scrubbed, F.current_timestamp(), known=kept, scrubbed=True)
    if prune_stale:
        fresh.write.mode("overwrite").parquet(f"{staging}/fresh")
        fresh = spark.read.schema(fresh.schema).parquet(f"{staging}/fresh")
        for key in ("path", "issue_key", "doc_id"):
            kept = ingest.prune_stale(kept, fresh, key)
    chunks = ingest.upsert_chunks(kept, fresh)
    store.chunks.write(chunks, version, bucket(chunks["source_id"], origin(chunks)), touched)

    held = last.filter("status = 'failed'").select("source_id").distinct()
    ends = last.filter("cursor is not null").join(held, "source_id", "left_anti").groupBy("source_id", "source_type").agg(F.max_by("cursor", "seq").alias("value"))
    keys = F.create_map(*(F.lit(x) for pair in CURSOR_KEYS.items() for x in pair))
    moved = ends.select("source_id", keys[F.col("source_type")].alias("key"), "value", F.current_timestamp().alias("at"))
    store.states.write(ingest.advance_cursors(store.states.read(version), moved), version, F.lit(0), [0])
    fs, path = store.chunks._fs()
    fs.delete(path(staging), True)


def sync(spark: SparkSession, feed_dir: str, table_dir: str, checkpoint: str, prune_stale: bool = False, files: int = 1000) -> StreamingQuery:
    """Run the feed (JSON files by FEED, `files` of them a batch) to its end. Offsets advance after
    a batch's versions are committed: at least once, and idempotent by batch id."""
    store = Store(spark, table_dir)
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", files).json(feed_dir)
    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, batch: apply_batch(store, df, batch, prune_stale)).start()
    )


def unique_jobs(jobs: DataFrame, key: str, at: str, period: str) -> DataFrame:
    """A stream of jobs without repeats of `key` within `period` of event time."""
    return jobs.withWatermark(at, period).dropDuplicatesWithinWatermark([key])



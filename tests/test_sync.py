"""Incremental sync: batches into versioned tables, cursors, audit, failures and re-runs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.runtime import ship
from tidemark.streaming import sync

KEY = "AKIA" + "0123456789ABCDEF"
CODE = "def one():\n    return 1\n\n\ndef two():\n    return 2\n"


def entry(source, kind, path, content, seq, status="modified", cursor=None, **more):
    return {"source_id": source, "source_type": kind, "repo": source, "ref": "HEAD", "path": path, "content": content, "status": status, "seq": seq, "cursor": cursor} | more


FIRST = [
    entry("g", "git_repo", "a.py", CODE, 1, cursor="sha1"), entry("g", "git_repo", "b.md", f"key {KEY}\n", 2, cursor="sha1"), entry("g", "git_repo", "c.md", "old words", 3, cursor="sha1"),
    entry("j", "jira_project", "J-1", "Summary\n\nthe body", 1, cursor="2024-01-02T00:00:00"),
    entry("d", "drive_folder", "doc1", "a document", 1, cursor="f9", name="Doc"), entry("d", "drive_folder", "doc2", None, 2, status="failed", cursor="f10", name="Doc 2"),
]
SECOND = [
    entry("g", "git_repo", "a.py", CODE.replace("2", "3"), 4, cursor="sha2"), entry("g", "git_repo", "c.md", None, 5, status="deleted", cursor="sha2"), entry("g", "git_repo", "d.md", "first", 5, cursor="sha2"),
    entry("g", "git_repo", "d.md", "second", 6, cursor="sha2"), entry("d", "drive_folder", "doc2", "now readable", 3, cursor="f11", name="Doc 2"),
]


def feed(spark, rows):
    return spark.read.schema(sync.FEED).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 2))


def chunks(store, before=None):
    return {(r["source_id"], r["context_breadcrumb"]): r["content"] for r in store.chunks.read(before).collect()}


def states(store):
    return {r["source_id"]: dict(r["cursor"]) for r in store.states.read().collect()}


@pytest.fixture
def store(spark, tmp_path):
    ship(spark)
    return sync.Store(spark, str(tmp_path / "store"))


def test_two_batches(spark, store):
    sync.apply_batch(store, feed(spark, FIRST), 0)
    got = chunks(store)
    assert got == {
        ("g", "a.py > one"): "def one():\n    return 1", ("g", "a.py > two"): "def two():\n    return 2", ("g", "b.md"): "key [REDACTED:aws_access_key_id]", ("g", "c.md"): "old words",
        ("j", "jira:J-1"): "Summary", ("d", "drive:doc1"): "a document",
    } | {k: v for k, v in got.items() if k[0] == "j"}
    # doc2 couldn't be read, so its source's cursor stays where it was
    assert states(store) == {"g": {"last_sha": "sha1"}, "j": {"resolutiondate_watermark": "2024-01-02T00:00:00"}}
    (finding,) = store.findings.read().collect()
    assert finding["secret_type"] == "aws_access_key_id" and finding["source_id"] == "g" and KEY not in str(finding)
    assert all(r["tsv"] and len(r["embedding"]) == 384 for r in store.chunks.read().collect())

    before = store.chunks.manifest()
    sync.apply_batch(store, feed(spark, SECOND), 1)
    now = chunks(store)
    assert now[("g", "a.py > two")].endswith("3") and ("g", "c.md") not in now and now[("g", "d.md")] == "second" and now[("d", "drive:doc2")] == "now readable" and now[("d", "drive:doc1")] == "a document"
    assert states(store) == {"g": {"last_sha": "sha2"}, "j": {"resolutiondate_watermark": "2024-01-02T00:00:00"}, "d": {"start_page_token": "f11"}}
    # only the buckets of changed files were written
    touched = {r["b"] for r in feed(spark, SECOND).select(sync.bucket(F.col("source_id"), F.col("path")).alias("b")).collect()}
    after = store.chunks.manifest()
    assert {b for b, v in after.items() if v == 2} <= touched and all(after[b] == v for b, v in before.items() if b not in touched)
    assert chunks(store, 2) == got  # the older version is still whole


def test_a_batch_that_comes_again_changes_nothing(spark, store, monkeypatch):
    sync.apply_batch(store, feed(spark, FIRST), 0)
    want, cursors = chunks(store), states(store)
    ids = {r["id"] for r in store.chunks.read().collect()}
    sync.apply_batch(store, feed(spark, FIRST), 0)
    assert chunks(store) == want and states(store) == cursors and {r["id"] for r in store.chunks.read().collect()} == ids and store.findings.read().count() == 1

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # fails after the chunks, before the cursors
        m.setattr(sync.ingest, "advance_cursors", broken)
        with pytest.raises(RuntimeError):
            sync.apply_batch(store, feed(spark, SECOND), 1)
    assert states(store) == cursors
    sync.apply_batch(store, feed(spark, SECOND), 1)
    assert states(store)["g"] == {"last_sha": "sha2"} and chunks(store)[("g", "d.md")] == "second"


def test_stale_chunks_and_kept_embeddings(spark, store):
    sync.apply_batch(store, feed(spark, FIRST), 0)
    shrunk = [entry("g", "git_repo", "a.py", "def one():\n    return 1\n", 9)]
    sync.apply_batch(store, feed(spark, shrunk), 1)
    assert ("g", "a.py > two") in chunks(store)  # as a plain upsert leaves it
    sync.apply_batch(store, feed(spark, shrunk), 2, prune_stale=True)
    assert ("g", "a.py > two") not in chunks(store) and ("g", "a.py > one") in chunks(store) and ("j", "jira:J-1") in chunks(store)


def test_vacuum_keeps_what_newer_versions_hold(spark, store):
    for batch, rows in enumerate([FIRST, SECOND, [entry("g", "git_repo", "e.md", "more", 9)]]):
        sync.apply_batch(store, feed(spark, rows), batch)
    want = chunks(store)
    store.vacuum(keep=1)
    assert store.chunks.versions() == [3] and chunks(store) == want and states(store)["g"] == {"last_sha": "sha2"}


def test_stream_of_files(spark, tmp_path):
    ship(spark)
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in FIRST))
    run = lambda: sync.sync(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    run()
    (folder / "2.json").write_text("\n".join(json.dumps(r) for r in SECOND))
    run()
    run()  # nothing new
    store = sync.Store(spark, str(tmp_path / "t"))
    assert chunks(store)[("g", "d.md")] == "second" and store.chunks.versions() == [1, 2]


def test_unique_jobs(spark, tmp_path):
    folder = tmp_path / "jobs"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"key": k, "at": f"2024-01-01T00:0{m}:00"}) for k, m in [("a", 0), ("a", 1), ("b", 1), ("a", 2)]))
    jobs = spark.readStream.schema("key string, at timestamp").json(str(folder))
    query = sync.unique_jobs(jobs, "key", "at", "15 minutes").writeStream.format("memory").queryName("jobs_once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["key"] for r in spark.table("jobs_once").collect()) == ["a", "b"]


def test_cursors_of_several_keys_make_one_state(spark):
    states_ = spark.createDataFrame([("s", {"k": "1", "x": "y"}, "error", None), ("t", {"k": "5"}, "idle", None)], "source_id string, cursor map<string,string>, status string, last_synced_at timestamp")
    moved = spark.createDataFrame([("s", "k", "2"), ("s", "k", "3"), ("s", "l", "4"), ("t", "k", None), ("u", "k", "9")], "source_id string, key string, value string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    got = {r["source_id"]: (dict(r["cursor"]), r["status"]) for r in ingest.advance_cursors(states_, moved).collect()}
    assert got == {"s": ({"k": "3", "l": "4", "x": "y"}, "idle"), "t": ({"k": "5"}, "idle"), "u": ({"k": "9"}, "idle")} and ingest.advance_cursors(states_, moved).count() == 3


def test_merge_refuses_repeated_keys_and_replaces_what_it_should(spark):
    old = spark.createDataFrame([("s", "k", "old", "r0", "h0")], "source_id string, chunk_key string, content string, repo string, content_hash string")
    new = spark.createDataFrame([("s", "k", "new", "r1", "h1"), ("s", "l", "x", "r1", "h2")], old.schema)
    got = {tuple(r) for r in ingest.merge(old, new, ["source_id", "chunk_key"], ingest.REPLACED).collect()}
    assert got == {("s", "k", "new", "r0", "h1"), ("s", "l", "x", "r1", "h2")}
    with pytest.raises(Exception, match="a key occurs twice"):
        ingest.merge(old, new.union(new), ["source_id", "chunk_key"], ["content"]).collect()


def test_gitlinks_are_no_entries(spark):
    old = spark.createDataFrame([("a", "1", "100644"), ("sub", "2", "160000")], "path string, content_hash string, mode string")
    new = spark.createDataFrame([("a", "1", "100644"), ("sub", "3", "160000"), ("b", "4", "100644")], old.schema)
    assert {tuple(r) for r in ingest.changed_entries(old, new).collect()} == {("b", "modified")}
    assert {r["path"] for r in ingest.changed_entries(None, new).collect()} == {"a", "b"}


def test_unchanged_heads_are_no_work(spark):
    heads = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source_id string, sha string")
    known = spark.createDataFrame([("a", {"last_sha": "1"}), ("b", {"last_sha": "0"})], "source_id string, cursor map<string,string>")
    assert {r["source_id"] for r in ingest.moved_heads(heads, known).collect()} == {"b", "c"}


def test_insert_raw_is_checked(spark):
    row = {"source_id": "s", "source_type": "git_repo", "natural_key": "k", "raw_content": "text"}
    assert ingest.insert_raw([row, row | {"raw_content": "a\0b"}], spark).count() == 1
    for bad, message in [(row | {"source_type": "svn"}, "domain"), ({k: v for k, v in row.items() if k != "natural_key"}, "natural_key is missing"), (row | {"x": 1}, "x is unknown")]:
        with pytest.raises(ValueError, match=message):
            ingest.insert_raw([row, bad], spark)

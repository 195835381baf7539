"""Chunk rows of the file pipeline against plain Python, and the guards before and on write."""

import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import scalar, vector
from tidemark.operators import chunk, ingest, scrub
from tidemark.plans import catalog
from tidemark.runtime import ship

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chunk_pipeline_against_plain_python(spark):
    want = set()
    for r in catalog.files(spark, SMALL).collect():
        out = scrub.scrub(r["content"], "git_repo")
        key = f"repo:{r['source_id']}:{r['path']}"
        for i, c in enumerate(chunk.heuristic(out["redacted_content"])):
            chunk_key = sha(f"{key}|{i}|")
            identity = str(uuid.UUID(sha(f"{r['source_id']}|{chunk_key}")[:32]))
            want.add((identity, r["source_id"], chunk_key, sha(c["text"]), r["path"], "heuristic_fallback", out["secrets_status"]))
    got = [tuple(r) for r in catalog.QUERIES["chunk_pipeline"](spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_several_chunks_of_one_file_are_numbered(spark):
    ship(spark)
    text = "\n\n".join(f"def f{i}():\n    return {i}" for i in range(3))
    raw = spark.createDataFrame([("s", "git_repo", "r", "python", "repo:s:a.py", None, text, {"path": "a.py"}), ("s", "git_repo", "r", None, "repo:s:n", None, "a\n\nb", None)], model.RAW_FILES)
    rows = {(r["context_breadcrumb"], r["chunk_index"]): r for r in chunk.chunk_rows(scrub.scrub_rows(raw)).collect()}
    assert set(rows) == {("a.py > f0", 0), ("a.py > f1", 1), ("a.py > f2", 2), ("repo:s:n", 0), ("repo:s:n", 1)}
    assert rows[("a.py > f1", 1)]["chunk_key"] == sha("repo:s:a.py|1|f1") and rows[("a.py > f1", 1)]["parse_status"] == "ok"


def test_cancelled_and_binary_rows_give_no_chunks(spark):
    ship(spark)
    files = [("s", "r", "HEAD", "a.txt", "fine"), ("s", "r", "HEAD", "b.txt", "bad\0"), ("s", "r", "HEAD", "c.txt", None), ("s", "r", "HEAD", "d.py", "x" * 2_000_001), ("s", "r", "HEAD", "e.txt", "y" * 5_000_001)]
    rows = ingest.chunk_table(ingest.raw_rows(spark.createDataFrame(files, "source_id string, repo string, ref string, path string, content string")), F.current_timestamp())
    assert [r["context_breadcrumb"] for r in rows.collect()] == ["a.txt"]
    assert rows.columns == model.CHUNKS.fieldNames()


def test_known_embeddings_are_kept(spark):
    ship(spark)
    raw = ingest.raw_rows(spark.createDataFrame([("s", "r", "HEAD", "a.txt", "one"), ("s", "r", "HEAD", "b.txt", "two")], "source_id string, repo string, ref string, path string, content string"))
    first = ingest.chunk_table(raw, F.current_timestamp())
    odd = first.filter("content = 'one'").withColumn("embedding", F.array(*[F.lit(9.0).cast("float")] * 384))
    got = {r["content"]: r["embedding"][0] for r in ingest.chunk_table(raw, F.current_timestamp(), known=odd).collect()}
    assert got["one"] == 9.0 and got["two"] == {r["content"]: r["embedding"][0] for r in first.collect()}["two"]


def test_preflight_bounds(spark):
    rows = [("python", "x" * 2_000_000, None), ("python", "x" * 2_000_001, "too_large"), ("cobol", "x", "unsupported_language"), (None, "x", "unsupported_language"), ("go", "a\0b", "binary"), ("go", "fine", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, lang string, content string")
    got = [r["p"] for r in df.select("i", scalar.preflight(F.col("lang"), F.col("content")).alias("p")).orderBy("i").collect()]
    assert got == [w for *_, w in rows]


@pytest.mark.parametrize("column, good, bad", [("source_type", "git_repo", "svn"), ("policy", "deny", "maybe"), ("parse_status", "crashed_fallback", "done"), ("secrets_status", "redacted", None)])
def test_domains_are_checked_on_write(spark, column, good, bad):
    make = lambda v: spark.createDataFrame([(v,)], f"{column} string")
    assert model.check_domains(make(good)).first()[0] == good
    with pytest.raises(Exception, match=f"{column} is outside its domain"):
        model.check_domains(make(bad)).collect()


def test_small_texts(spark):
    df = spark.createDataFrame([("a\r\nb\rc\n", "50%_\\x", "e" * 999)], "a string, b string, c string")
    row = df.select(scalar.normalise_newlines(F.col("a")), scalar.like_escape(F.col("b")), F.length(scalar.error_body(F.col("c"))), scalar.with_breadcrumb(F.lit("p > f"), F.lit("text")), scalar.with_breadcrumb(F.lit(""), F.lit("text"))).first()
    assert tuple(row) == ("a\nb\nc\n", "50\\%\\_\\\\x", 200, "p > f\n\ntext", "text")


def test_embedding_of_rows_and_vectors_by_place(spark):
    """Vectors go to the rows that they were made for, or the query fails."""
    ship(spark)

    class Short:
        dimensions = 2

        def embed_batch(self, texts):
            return vector.np.zeros((len(texts) - 1, 2))

    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="another number of vectors"):
        df.select(vector.embed_column(Short, F.col("t"))).collect()
    with pytest.raises(Exception, match="no embedding sidecar"):
        df.select(vector.embed_column(vector.SidecarEmbedder, F.col("t"))).collect()


def test_heuristic_table_function(spark):
    ship(spark)
    chunk.register(spark)
    got = spark.sql("SELECT c.chunk_index, c.text, c.start_line FROM VALUES ('a\n\nb') AS t(x), LATERAL heuristic_chunks(t.x) c").collect()
    assert [tuple(r) for r in got] == [(0, "a", 1), (1, "b", 3)]


def test_chunk_text_keeps_every_solid_line():
    source = "\n".join(f"line {i} {{" if i % 7 == 0 else f"line {i} }}" if i % 7 == 3 else "" if i % 5 == 0 else f"line {i}" for i in range(400))
    found = chunk.heuristic(source)
    solid = [x for x in source.split("\n") if x.strip()]
    assert [x for c in found for x in c["text"].split("\n") if x.strip()] == solid
    assert all(re.match(r"\S", c["text"]) for c in found) and all(a["end_line"] < b["start_line"] for a, b in zip(found, found[1:]))

"""The tools, their messages, health, and the retrieval harness."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import api, model
from tidemark.functions import vector
from tidemark.operators import grep as text_search
from tidemark.operators import ingest
from tidemark.plans import catalog, harness
from tidemark.runtime import ship

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("1", "git_repo", "alpha", "a", "allow", True, {"mirror_slug": "slug-a"}), ("2", "git_repo", "beta", "b", "deny", True, {}), ("3", "jira_project", "proj", "c", "allow", True, {})]
    return spark.createDataFrame(rows, "id string, source_type string, name string, identifier string, policy string, active boolean, config map<string,string>")


@pytest.fixture(scope="module")
def files(spark):
    rows = [("slug-a", "HEAD", "x.txt", "one fish\ntwo fish\n\nred\n"), ("slug-a", "v1", "x.txt", "old fish"), ("beta", "HEAD", "y.txt", "fish"), ("slug-a", "HEAD", "big", "b" * 5_000_001), ("slug-a", "HEAD", "bin", "fish\0")]
    return spark.createDataFrame(rows, "repo string, ref string, path string, content string")


def test_list_repos(sources):
    assert api.list_repos(sources) == {"repos": [{"repo": "slug-a", "source_type": "git_repo"}, {"repo": "proj", "source_type": "jira_project"}]}


def test_grep(sources, files):
    out = api.grep(sources, files, "fish$")
    assert out == {"matches": [{"repo": "slug-a", "path": "x.txt", "line": 1, "text": "one fish"}, {"repo": "slug-a", "path": "x.txt", "line": 2, "text": "two fish"}], "truncated": False}
    assert api.grep(sources, files, "^$", "slug-a")["matches"] == [{"repo": "slug-a", "path": "x.txt", "line": 3, "text": ""}]
    for pattern in ("", " ", ".", ".*", ".+"):
        with pytest.raises(api.ToolError, match="^pattern is too broad — provide a more specific pattern$"):
            api.grep(sources, files, pattern)
    for repo in ("beta", "nowhere", "proj"):
        with pytest.raises(api.ToolError, match=r"^repo not found \(see list_repos\)$"):
            api.grep(sources, files, "fish", repo)
    with pytest.raises(api.ToolError, match="^grep failed — check the pattern is a valid regex$"):
        api.grep(sources, files, "a\\(")


def test_grep_budgets(spark):
    many = spark.createDataFrame([(f"r{i}", "HEAD", "f", "\n".join(["fish"] * 150)) for i in range(6)], "repo string, ref string, path string, content string")
    rows, cut = text_search.grep(many, "fish")
    assert len(rows) == 500 and cut and rows[0]["repo"] == "r0" and max(r["line"] for r in rows) == 100
    rows, cut = text_search.grep(many.limit(1), "fish")
    assert len(rows) == 100 and not cut
    wide = spark.createDataFrame([("r", "HEAD", "f", "\n".join(["fish" + "x" * 300_000] * 5))], many.schema)
    rows, cut = text_search.grep(wide, "fish")
    assert len(rows) == 3 and cut and all(len(r["text"]) == 300_004 for r in rows)
    rows, cut = text_search.grep(wide, "fish", limit_bytes=10_000_000)
    assert len(rows) == 5 and not cut


def test_get_file(sources, files):
    assert api.get_file(sources, files, "slug-a", "x.txt", "v1")["content"] == "old fish"
    for args, message in [
        (("beta", "y.txt"), r"repo not found \(see list_repos\)"), (("slug-a", "../x"), "invalid path — path traversal is rejected"), (("slug-a", "x.txt", "-x"), "invalid ref"),
        (("slug-a", "none"), "file or ref not found"), (("slug-a", "big"), "file too large to return"),
    ]:
        with pytest.raises(api.ToolError, match=f"^{message}$"):
            api.get_file(sources, files, *args)


@pytest.fixture(scope="module")
def chunks(spark):
    ship(spark)
    docs = [("s1", "git_repo", "r1", "alpha.md", "the quick brown foxes are jumping"), ("s1", "git_repo", "r1", "beta.md", "lazy dogs sleep all day"), ("s2", "jira_project", None, "P-1", "a fox and a dog")]
    raw = spark.createDataFrame([(a, b, c, None, f"k:{p}", None, t, {"path": p}) for a, b, c, p, t in docs], model.RAW_FILES)
    embed = lambda text: vector.embed_column(vector.HashEmbedder, text)
    return ingest.chunk_table(raw, F.lit("2024-01-01").cast("timestamp"), embed)


def test_semantic_search(chunks):
    q = [float(x) for x in vector.HashEmbedder().embed_batch(["quick fox"])[0]]
    out = api.semantic_search(chunks, "quick fox", q)["results"]
    assert out[0]["breadcrumb"] == "alpha.md" and set(out[0]) == {"chunk_id", "source_type", "repo", "lang", "breadcrumb", "metadata", "score"} and len(out) == 3
    assert out[0]["score"] == pytest.approx(2 / 61)  # first in both legs: the stored search vector stems foxes
    assert [r["source_type"] for r in api.semantic_search(chunks, "fox", q, source="jira")["results"]] == ["jira_project"]
    assert {r["repo"] for r in api.semantic_search(chunks, "fox", q, repo="r1")["results"]} == {"r1"}
    assert len(api.semantic_search(chunks, "fox", q, top_k=1)["results"]) == 1
    with pytest.raises(api.ToolError, match='^unknown source "svn" — use git | jira | drive$'.replace("|", r"\|")):
        api.semantic_search(chunks, "fox", q, source="svn")


def test_health(spark):
    assert api.health(spark) == {"status": 200, "gates": {"session": "ok", "grammars": "skipped", "embedding_backend": "skipped", "embedding_warm": "skipped"}}
    assert api.health(spark, ("go", "java"))["gates"]["grammars"] == "ok" and api.health(spark, ("cobol",)) ["status"] == 503
    ready = api.Readiness()
    assert api.health(spark, embedder=ready)["status"] == 503
    ship(spark)
    assert ready.warm(spark, vector.HashEmbedder) and api.health(spark, embedder=ready)["status"] == 200
    assert not ready.warm(spark, vector.SidecarEmbedder) and api.health(spark, embedder=ready)["gates"]["embedding_warm"] == "not ready"
    assert api.health(None)["gates"]["session"].startswith("failed")


def test_embedding_column_keeps_rows_in_place(spark):
    ship(spark)
    texts = ["a", None, "b c d", "a", ""]
    got = [r["v"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", vector.embed_column(vector.HashEmbedder, F.col("t")).alias("v")).orderBy("i").collect()]
    want = vector.HashEmbedder().embed_batch([t or "" for t in texts])
    assert all(list(map(float, a)) == pytest.approx(list(b), abs=1e-6) for a, b in zip(got, want)) and got[0] == got[3]


def test_harness(spark, chunks, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text("\n".join(json.dumps({"query": q, "relevant": r}) for q, r in [("quick fox", [{"path_prefix": "alpha"}]), ("sleeping dog", [{"repo": "r1", "path_prefix": "beta"}]), ("nothing", [{"repo": "none"}])]))
    from tidemark.sources import queries

    out = harness.run(chunks, queries.load(spark, str(path)), vector.HashEmbedder)
    assert out["queries_loaded"] == 3 and out["quality"]["queries_resolved"] == 2 and out["quality"]["queries_unresolved"] == 1 and out["quality"]["mean_ndcg"] == pytest.approx(1.0)
    assert out["embedding"]["passages_per_second"] > 0 and out["targets"]["mean_ndcg"] is True and harness.throughput(5, 0) == 0
    assert harness.run(chunks.limit(0), queries.load(spark, str(path)), vector.SidecarEmbedder)["quality"] == {"skipped": "the corpus is empty"}
    assert len(set(harness.passages())) == harness.PASSAGES and 180 <= len(harness.passages()[0].split()) <= 205


def test_matryoshka_stability(chunks):
    q = [float(x) for x in vector.HashEmbedder().embed_batch(["quick fox"])[0]]
    assert harness.stability(chunks, [q], 384)["mean_overlap"] == 1.0


def test_nearest_against_brute_force(spark):
    import numpy as np

    ship(spark)
    rng = np.random.default_rng(3)
    base = [(i, v) for i, v in enumerate(rng.integers(-2, 3, (300, 4)).astype(float).tolist())] + [(900, None), (901, [0.0] * 4), (902, [1.0])]
    df = spark.createDataFrame(base, "id long, embedding array<double>").repartition(3)
    got = sorted((r["query"], r["rank"], r["id"]) for r in vector.nearest(df, df.filter("id % 50 = 0"), 5, block=64).collect())
    want = []
    fine = [(i, np.array(v)) for i, v in base if v is not None and len(v) == 4 and any(v)]
    for i, q in fine:
        if i % 50 == 0:
            d = sorted((round(1 - float(q @ v) / float(np.linalg.norm(q) * np.linalg.norm(v)), 12) + 0.0, j) for j, v in fine)
            want += [(i, r + 1, j) for r, (_, j) in enumerate(d[:5])]
    assert len(got) == len(want) and got == sorted(want)


def test_cosine_to_equals_cosine_distance(spark):
    q = [0.5, -1.0, 2.0]
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, [1.0, 2.0]), (4, None), (5, [1.0, 2.0, 3.0, 4.0]), (6, [1.0, None, 3.0])], "id int, v array<double>")
    got = {r["id"]: (r["a"], r["b"]) for r in df.select("id", vector.cosine_to("v", q).alias("a"), vector.cosine_distance(F.col("v"), F.array(*map(F.lit, q))).alias("b")).collect()}
    assert got[1][0] == pytest.approx(got[1][1]) and got[2][0] != got[2][0] and [got[i][0] for i in (3, 4, 5, 6)] == [None] * 4


def test_query_subsets_are_whole_tables(spark):
    status = catalog.QUERIES["source_status"](spark, SMALL)
    assert status.agg(F.sum("chunks")).first()[0] == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()

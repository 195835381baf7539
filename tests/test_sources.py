"""Git mirrors, issue and document clients, query sets."""

import json
import subprocess

import pytest

from tidemark.functions import scalar
from tidemark.runtime import ship
from tidemark.sources import drive, git, http, issues, queries


def run(*args, cwd):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=cwd, check=True, capture_output=True)


@pytest.fixture
def origin(tmp_path):
    home = tmp_path / "origin"
    home.mkdir()
    run("init", "-q", "-b", "main", cwd=home)
    (home / "a b.txt").write_text("one\ntwo\n")
    (home / "é.py").write_text("x = 1\n")
    (home / "bin").write_bytes(b"\0\1\n\n2")
    run("add", "-A", cwd=home)
    run("commit", "-qm", "first", cwd=home)
    return home


def test_mirror(spark, origin, tmp_path):
    ship(spark)
    mirror = git.Mirror(str(tmp_path / "mirrors"), "slug")
    mirror.ensure(f"file://{origin}")
    first = mirror.head()
    got = {r["path"]: bytes(r["content"]) for r in mirror.snapshot(spark, "s").collect()}
    assert got == {"a b.txt": b"one\ntwo\n", "é.py": b"x = 1\n", "bin": b"\0\1\n\n2"}
    (origin / "new").write_text("n")
    run("add", "-A", cwd=origin)
    run("commit", "-qm", "second", cwd=origin)
    mirror.ensure(f"file://{origin}")
    assert mirror.head() != first and mirror.head("main") == mirror.head() and mirror.snapshot(spark, "s", first).count() == 3 and mirror.snapshot(spark, "s").count() == 4
    with pytest.raises(git.GitError):
        mirror.head("nowhere")


def test_mirror_refuses_bad_input(tmp_path):
    for slug in ("../x", "/abs", "-o"):
        with pytest.raises(ValueError):
            git.Mirror(str(tmp_path), slug)
    mirror = git.Mirror(str(tmp_path), "ok")
    for url in ("ext::sh -c x", "--upload-pack=x", "ftp://x"):
        with pytest.raises(ValueError):
            mirror.ensure(url)
    for ref in ("-x", "a b", ""):
        with pytest.raises(ValueError):
            mirror.head(ref)


def test_empty_repository(spark, tmp_path):
    (tmp_path / "e").mkdir()
    run("init", "-q", cwd=tmp_path / "e")
    mirror = git.Mirror(str(tmp_path), "empty")
    mirror.ensure(f"file://{tmp_path / 'e'}")
    assert mirror.head() is None and mirror.snapshot(spark, "s").count() == 0


def test_jql():
    assert issues.jql("P", None) == 'project = "P" AND status in (Resolved, Closed, Done) ORDER BY resolutiondate ASC'
    assert ' AND resolutiondate >= "2024-01-01"' in issues.jql("P", "2024-01-01")


def test_adf_breaks_and_nesting():
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "text", "text": "b"}]}, {"type": "rule"}, {"type": "text"}]}
    assert issues.adf_text(tree) == "a\nb" and issues.adf_text(None) == "" and issues.adf_text("plain") == "plain"


def test_issue_pages_and_limits(spark):
    ship(spark)
    asked = []

    def get(path, params):
        asked.append(params)
        start = params["startAt"]
        found = [{"key": f"P-{i}", "fields": {"summary": f"s{i}", "description": None, "resolutiondate": f"2024-01-0{i + 1}"}} for i in range(start, min(start + 2, 5))]
        return 200, {}, json.dumps({"total": 5, "issues": found})

    rows = issues.parse_issues(issues.fetch(spark, get, "P", "2024-01-01", page=2)).collect()
    assert sorted(r["key"] for r in rows) == [f"P-{i}" for i in range(5)] and [p["startAt"] for p in asked] == [0, 2, 4] and "2024-01-01" in asked[0]["jql"]
    for header, seconds in [({"Retry-After": "7"}, 7), ({"retry-after": "soon"}, 60), ({}, 60), ({"Retry-After": "0"}, 60)]:
        with pytest.raises(http.Snooze) as e:
            issues.fetch(spark, lambda p, q: (429, header, ""), "P", None)
        assert e.value.seconds == seconds
    for answer in ((500, {}, "x" * 999), (200, {}, "no json"), (200, {}, "[]")):
        with pytest.raises(http.Failed) as e:
            issues.fetch(spark, lambda p, q: answer, "P", None)
        assert len(str(e.value)) < 220


def test_drive_pages_cursor_and_exports(spark):
    ship(spark)
    doc = lambda i, kind=drive.DOCUMENT: {"fileId": i, "removed": False, "file": {"id": i, "name": i.upper(), "mimeType": kind}}
    pages = {"t0": {"nextPageToken": "t1", "changes": [doc("a"), doc("b"), doc("img", "image/png")]}, "t1": {"newStartPageToken": "f10", "changes": [{"fileId": "a", "removed": True}, {"fileId": "z"}]}}

    def get(path, params):
        return 200, {}, json.dumps({"startPageToken": "f9"} if path.endswith("startPageToken") else pages[params["pageToken"]])

    removed, docs, cursor = drive.parse_changes(drive.fetch(spark, get, None))
    assert removed.count() == docs.count() == 0 and cursor.first()["cursor"] == "f9"
    removed, docs, cursor = drive.parse_changes(drive.fetch(spark, get, "t0"))
    assert {r["id"] for r in removed.collect()} == {"a", "z"} and {r["id"] for r in docs.collect()} == {"b"} and cursor.first()["cursor"] == "f10"

    def export(path, params):
        return (200, {}, "text of " + path) if "good" in path else (404, {}, "gone")

    some = spark.createDataFrame([("good/1", "G"), ("bad", "B")], "id string, name string")
    fine, failed = drive.exported(some, drive.fetch_exports(some, export))
    assert [r["content"] for r in fine.collect()] == ["text of /files/good%2F1/export?mimeType=text%2Fmarkdown"] and [r["error"] for r in failed.collect()] == ["404: gone"]


def test_cursor_without_pages_counts_up(spark):
    bodies = spark.createDataFrame([(json.dumps({"newStartPageToken": t, "changes": []}),) for t in ("f9", "f10")], "body string")
    assert drive.parse_changes(bodies)[2].first()["cursor"] == "f10"


def test_query_sets(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    good = [{"query": "a", "relevant": [{"repo": "r"}], "note": "n"}, {"query": "b", "relevant": []}]
    path.write_text("\n".join(map(json.dumps, good)) + "\n\n")
    assert queries.load(spark, str(path)).count() == 2
    for bad in ({"query": "c", "relevant": [{}]}, {"query": "c", "relevant": [{"other": "x"}]}, {"relevant": [{"repo": "r"}]}, {"query": "c"}):
        path.write_text("\n".join(map(json.dumps, [*good, bad])))
        with pytest.raises(ValueError):
            queries.load(spark, str(path))


def test_basic_regular_expressions():
    import re

    for bre, hit, miss in [("a\\+b", "aab", "a+b"), ("a+b", "a+b", "aab"), ("\\(x\\|y\\)z", "yz", "(y"), ("(x)", "(x)", "x"), ("[)(]+", "(+", "x"), ("a\\{2\\}$", "aa", "a{2}"), ("^*a", "*a", "ba")]:
        found = re.compile(scalar.java_regex(bre))
        assert found.search(hit) and not found.search(miss), bre

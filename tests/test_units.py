"""Pure functions of scrubbing, chunking, text search, metrics and guards."""

import subprocess
import sys
from pathlib import Path

import pytest

from tidemark.functions import scalar, stemmer
from tidemark.operators import ingest, metrics, scrub

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("word, want", [("running", "run"), ("relational", "relat"), ("ponies", "poni"), ("happy", "happi"), ("generalization", "general")])
def test_stem(word, want):
    assert stemmer.stem(word) == want


@pytest.mark.parametrize("p, want", [(50, 5), (95, 10), (99, 10), (0, 1)])
def test_percentile_rank(p, want):
    assert metrics.percentile_rank(list(range(1, 11)), p) == want
    assert metrics.percentile_rank([], p) is None


@pytest.mark.parametrize("value, want", [(5, 5), (1000, 100), (0, 20), (-1, 20), (None, 20), ("7", 20)])
def test_clamp_top_k(value, want):
    assert scalar.clamp_top_k(value) == want


def test_guards():
    assert scalar.valid_ref("HEAD") and not scalar.valid_ref("--upload-pack=x")
    assert scalar.valid_path("lib/a.ex") and not scalar.valid_path("../etc/passwd") and not scalar.valid_path("/etc/passwd")
    assert scalar.valid_url("https://example.org/a.git") and not scalar.valid_url("ext::sh -c x")


def test_scrub_leaves_clean_text():
    out = scrub.scrub("nothing to see", "jira_project")
    assert out["redacted_content"] == "nothing to see" and out["secrets_status"] == "clean" and not out["findings"]


def test_first_sync_adds_and_later_syncs_modify_or_delete(spark):
    schema = "path string, mode string, content_hash string"
    old = spark.createDataFrame([("a", "100644", "1"), ("b", "100644", "1"), ("c", "100644", "1")], schema)
    new = spark.createDataFrame([("a", "100644", "1"), ("b", "100644", "2"), ("d", "100644", "1")], schema)
    entries = lambda df: sorted((r["path"], r["status"]) for r in df.collect())
    assert entries(ingest.changed_entries(old, new)) == [("b", "modified"), ("c", "deleted"), ("d", "modified")]
    assert {s for _, s in entries(ingest.changed_entries(None, new))} == {"added"}


def test_nothing_imports_the_llm_subpackage():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "tidemark").parts:
            assert "tidemark.llm" not in p.read_text(), p


def test_entry_works_without_the_llm_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert all(int(n) > 0 for n in said.stdout.split())

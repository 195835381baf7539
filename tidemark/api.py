"""The four tools and the health report, as plain functions with stable error messages."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.functions.vector import embed_column
from tidemark.model import SOURCE_ALIASES
from tidemark.operators import chunk, grep as text_search, hybrid, registry


class ToolError(ValueError):
    """An error to show to the caller as it is."""


def semantic_search(chunks: DataFrame, query: str, embedding: list[float], source: str | None = None, repo: str | None = None, lang: str | None = None, top_k: object = None, config: str = "english") -> dict:
    """The best chunks for a query, without content."""
    if source is not None and source not in SOURCE_ALIASES:
        raise ToolError(f'unknown source "{source}" — use git | jira | drive')
    hits = hybrid.hybrid_search(chunks, query, embedding, top_k, config=config, repo=repo, lang=lang, source_type=SOURCE_ALIASES.get(source))
    names = {"id": "chunk_id", "context_breadcrumb": "breadcrumb"}
    return {"results": [{names.get(k, k): v for k, v in r.asDict().items()} for r in hits.collect()]}


def _slugs(sources: DataFrame, repo: str | None) -> list[str]:
    found = [r["repo"] for r in registry.resolve(sources, repo).collect()]
    if repo is not None and not found:
        raise ToolError("repo not found (see list_repos)")
    return found


def grep(sources: DataFrame, files: DataFrame, pattern: str, repo: str | None = None) -> dict:
    """Lines that match a basic regular expression in one repository or in all."""
    if pattern.strip() in text_search.TOO_BROAD:
        raise ToolError("pattern is too broad — provide a more specific pattern")
    scope = files.filter((F.col("ref") == "HEAD") & F.col("repo").isin(_slugs(sources, repo)))
    try:  # compiled here first, since a pattern that fails in a task fails the job
        files.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile("(?m)" + scalar.java_regex(pattern))
    except (Py4JJavaError, PySparkException):
        raise ToolError("grep failed — check the pattern is a valid regex") from None
    matches, truncated = text_search.grep(scope, pattern)
    return {"matches": matches, "truncated": truncated}


def get_file(sources: DataFrame, files: DataFrame, repo: str, path: str, ref: str = "HEAD") -> dict:
    """One file of a registered repository."""
    _slugs(sources, repo)
    if not scalar.valid_path(path):
        raise ToolError("invalid path — path traversal is rejected")
    if not scalar.valid_ref(ref):
        raise ToolError("invalid ref")
    row = text_search.get_file(files, repo, path, ref).first()
    if row is None:
        raise ToolError("file or ref not found")
    if row["too_large"]:
        raise ToolError("file too large to return")
    return {"repo": repo, "path": path, "ref": ref, "content": row["content"]}


def list_repos(sources: DataFrame) -> dict:
    return {"repos": [r.asDict() for r in registry.list_repos(sources).collect()]}


class Readiness:
    """Warm-up of an embedder: not ready until it has embedded a text in each worker slot."""

    def __init__(self) -> None:
        self.ready, self.backend = False, None

    def warm(self, spark: SparkSession, make: Callable[[], object]) -> bool:
        """Load the embedder that make() gives in the workers and embed one text with each."""
        slots = spark.sparkContext.defaultParallelism
        texts = spark.range(0, slots, 1, slots).select(F.lit("warm up").alias("text"))
        try:
            sizes = {r["n"] for r in texts.select(F.size(embed_column(make, F.col("text"))).alias("n")).collect()}
            self.ready, self.backend = sizes == {make().dimensions}, type(make()).__name__
        except (PySparkException, Py4JError, NotImplementedError, ValueError) as e:
            self.ready, self.backend = False, str(e).splitlines()[0][:200]
        return self.ready


def health(spark: SparkSession, languages: tuple[str, ...] = (), embedder: Readiness | None = None) -> dict:
    """Gates: the session answers; syntax chunkers for `languages` are there; the embedder has a
    backend and is warm. What isn't asked for is skipped, which passes. No gate raises."""
    missing = sorted(set(languages) - set(chunk.CHUNKERS))
    try:
        session = "ok" if spark.range(1).count() == 1 else "failed"
    except Exception as e:  # a gate reports, whatever happens
        session = f"failed: {str(e).splitlines()[0][:200]}"
    gates = {
        "session": session,
        "grammars": "skipped" if not languages else "ok" if not missing else "missing: " + ", ".join(missing),
        "embedding_backend": "skipped" if embedder is None else "ok" if embedder.backend and embedder.ready else f"failed: {embedder.backend}",
        "embedding_warm": "skipped" if embedder is None else "ok" if embedder.ready else "not ready",
    }
    fine = all(v in ("ok", "skipped") for v in gates.values())
    return {"status": 200 if fine else 503, "gates": gates}

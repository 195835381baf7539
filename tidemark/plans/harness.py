"""Retrieval benchmark over a chunk table: quality, latency, embedding throughput and memory."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vector import embed_column
from tidemark.operators import hybrid, metrics

SENTENCE = "Chunks of code and prose are stored with vectors, so that a question finds them by meaning and by words. "
PASSAGES, REPEATS = 20, 10
TARGETS = {"mean_ndcg": 0.55, "p99": 300.0, "passages_per_second": 10.0, "peak_mb": 1536.0}


def passages() -> list[str]:
    """Texts of about 190 words for the throughput probe, no two alike."""
    return [f"Passage {i}. " + SENTENCE * REPEATS for i in range(PASSAGES)]


def throughput(count: int, seconds: float) -> float:
    """Items a second; 0 without time."""
    return count / seconds if seconds > 0 else 0.0


def peak_mb() -> float:
    """The driver process's greatest resident memory so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def quality(chunks: DataFrame, queries: DataFrame, make: Callable, k: int = 10, config: str = "english") -> dict:
    """Mean nDCG and latency percentiles of queries(query, relevant) by hybrid search; a query whose
    matchers fit no chunk is unresolved and counts in neither. Latency includes embedding the query."""
    if chunks.isEmpty():
        return {"skipped": "the corpus is empty"}
    spark, embedder = chunks.sparkSession, make()
    rows = []
    for q in queries.select("query", "relevant").collect():  # a query set, not a table
        wanted = metrics.relevant(chunks, [m.asDict() for m in q["relevant"]])
        if wanted.isEmpty():
            rows.append((False, None, None))
            continue
        began = time.perf_counter()
        vector = [float(x) for x in embedder.embed_batch([q["query"]])[0]]
        found = [r["id"] for r in hybrid.hybrid_search(chunks, q["query"], vector, k, config=config).select("id").collect()]
        took = (time.perf_counter() - began) * 1e3
        ranked = spark.createDataFrame([(q["query"], i + 1, x) for i, x in enumerate(found)], "query string, rank int, id string")
        score = metrics.ndcg(ranked, wanted.select(F.lit(q["query"]).alias("query"), "id"), k).first()["ndcg"]
        rows.append((True, float(score), took))
    scored = spark.createDataFrame(rows, "resolvable boolean, ndcg double, latency_ms double")
    return metrics.summary(scored).first().asDict()


def embedding(spark, make: Callable) -> dict:
    """Passages a second through the embedding column, and the growth of the driver's memory."""
    before = peak_mb()
    df = spark.createDataFrame([(t,) for t in passages()], "text string").coalesce(1)
    began = time.perf_counter()
    n = len(df.select(embed_column(make, F.col("text")).alias("v")).collect())
    return {"passages_per_second": throughput(n, time.perf_counter() - began), "memory_growth_mb": peak_mb() - before, "peak_mb": peak_mb()}


def stability(chunks: DataFrame, vectors: list[list[float]], size: int, k: int = 10) -> dict:
    """How far results stay when vectors are cut to `size` dimensions: mean overlap of the first k
    ids over query vectors. The full vectors stand in for a longer model output."""
    from tidemark.functions.vector import matryoshka

    cut = chunks.withColumn("embedding", matryoshka(F.col("embedding"), size))
    shares = []
    for v in vectors:
        ids = [{r["id"] for r in hybrid.vector_leg(c, q, k).collect()} for c, q in ((chunks, v), (cut, v[:size]))]
        shares.append(len(ids[0] & ids[1]) / max(len(ids[0]), len(ids[1]), 1))
    return {"mean_overlap": sum(shares) / len(shares) if shares else 0.0}


def run(chunks: DataFrame, queries: DataFrame, make: Callable, k: int = 10, config: str = "english") -> dict:
    """All sections, with each target met or not; a section that can't run says why."""
    out = {"queries_loaded": queries.count(), "quality": quality(chunks, queries, make, k, config)}
    try:
        out["embedding"] = embedding(chunks.sparkSession, make)
    except Exception as e:
        out["embedding"] = {"skipped": str(e).splitlines()[0][:200]}
    got = {**out["quality"], **out["embedding"]}
    better = {"mean_ndcg": float.__ge__, "p99": float.__le__, "passages_per_second": float.__ge__, "peak_mb": float.__le__}
    out["targets"] = {c: None if got.get(c) is None else better[c](float(got[c]), TARGETS[c]) for c in TARGETS}
    return out

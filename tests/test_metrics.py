"""Percentiles of groups of any shape, against sorting."""

import math
import random

import pytest

from tidemark.operators import metrics


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_percentiles_are_exact(spark, accuracy):
    rng = random.Random(5)
    groups = {
        "skewed": [rng.expovariate(1) for _ in range(2000)], "ties": [float(rng.randrange(3)) for _ in range(500)], "same": [7.0] * 300, "one": [1.5], "two": [2.0, 1.0],
        "nulls": [None, None], "some nulls": [None, 3.0, 1.0], None: [4.0, 5.0, 6.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    points = (0, 1, 50, 95, 99, 100)
    got = {r["g"]: [r[f"p{p}"] for p in points] for r in metrics.percentiles(df, "g", "v", points, accuracy).collect()}
    for g, vs in groups.items():
        kept = sorted(v for v in vs if v is not None)
        assert got[g] == ([kept[min(max(math.ceil(p * len(kept) / 100), 1), len(kept)) - 1] for p in points] if kept else [None] * len(points)), g
    assert metrics.percentiles(df.limit(0), "g", "v", (50,)).count() == 0


def test_ndcg_by_label_is_ndcg(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(12)], "id long, label int")
    queries = spark.createDataFrame([(0, 0), (1, 1), (99, 7)], "query long, label int")
    ranked = spark.createDataFrame([(q, r, i) for q, ids in [(0, [3, 1, 6]), (1, [0, 2, 5])] for r, i in enumerate(ids, 1)], "query long, rank int, id long")
    relevance = queries.join(rows, "label").select("query", "id")
    want = {r["query"]: r["ndcg"] for r in metrics.ndcg(ranked, relevance, 3).collect()}
    got = {r["query"]: r["ndcg"] for r in metrics.ndcg_by_label(ranked, queries, rows, 3).collect()}
    assert got == want | {99: 0.0} and got[0] > 0 and got[1] == 0

"""The pipeline against a version of each stage without Spark: plain loops, DuckDB and the library."""

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm.test_operators import all_links
from tidemark.llm import decontaminate, line_dedup, quality_crf, sentencepiece_tokens

SMALL = "/root/testdata/sf0.001"


def good_share(text, weight, pair):
    """Length-weighted marginal of good lines, by forward and backward sums over the two labels."""
    x, _, length = quality_crf.line_features(pa.array([text], pa.string()))
    if not len(x):
        return 0.0
    score = [[0.0, float(row @ weight)] for row in x]
    add = lambda a, b: float(np.logaddexp(a, b))
    ahead = [score[0]]
    for s in score[1:]:
        ahead.append([s[b] + add(ahead[-1][0] + pair[0][b], ahead[-1][1] + pair[1][b]) for b in (0, 1)])
    back = [[0.0, 0.0]]
    for s in score[:0:-1]:
        back.insert(0, [add(pair[a][0] + s[0] + back[0][0], pair[a][1] + s[1] + back[0][1]) for a in (0, 1)])
    total = add(*ahead[-1])
    marginal = [np.exp(f[1] + b[1] - total) for f, b in zip(ahead, back)]
    return float(sum(m * n for m, n in zip(marginal, length)) / max(length.sum(), 1))


def test_pipeline_against_brute_force(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    weight, pair = quality_crf.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    local = docs.toPandas().sort_values("doc_id")
    kept = [(int(d), t) for d, t in zip(local["doc_id"], local["text"]) if good_share(t, weight, pair) >= quality_crf.KEEP]
    assert 0 < len(kept) < len(local)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SMALL}/benchmark.parquet')")

    def sql(query, rows):
        con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": [t for _, t in rows]}))
        return con.execute(query).fetchall()

    cut = sorted(sql(line_dedup.SQL, kept))
    assert any(n for *_, n in cut)
    deduped = [(d, t) for d, t, n in cut if not n or t.strip(" \t\r\n")]

    group = {i: g for i, g, _ in all_links([t for _, t in deduped])}
    alone = [row for i, row in enumerate(deduped) if group.get(i, i) == i]
    assert len(alone) < len(deduped)

    held = {d for d, *_ in sql(decontaminate.SQL, alone)}
    clean = [(d, t) for d, t in alone if d not in held]
    assert held

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_tokens.MODEL)
    want = {(d, tuple(sp.encode(t))) for d, t in clean}
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r["doc_id"], tuple(r["ids"])) for r in out} == want and len(out) == len(want)
    assert all(r["parity"] and r["n_tokens"] == len(r["ids"]) for r in out)

"""The model-backed embedder on a tiny model written by hand, pooling and batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import api
from tidemark.functions import vector
from tidemark.runtime import ship

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
VOCABULARY, WIDTH = 49_408, 6


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def info(name, kind, *dims):
    shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    """(path, table): an encoder that looks each token up in a table and knows nothing else."""
    table = np.random.default_rng(1).normal(size=(VOCABULARY, WIDTH)).astype(np.float32)
    node = field(1, "table") + field(1, "input_ids") + field(2, "last_hidden_state") + field(4, "Gather")
    mask = field(1, "attention_mask") + field(2, "mask_out") + field(4, "Identity")
    held = field(1, VOCABULARY) + field(1, WIDTH) + field(2, 1) + field(8, "table") + field(9, table.tobytes())
    graph = field(1, node) + field(1, mask) + field(2, "g") + field(5, held) + field(11, info("input_ids", 7, "b", "t")) + field(11, info("attention_mask", 7, "b", "t"))
    graph += field(12, info("last_hidden_state", 1, "b", "t", WIDTH)) + field(12, info("mask_out", 7, "b", "t"))
    path = tmp_path_factory.mktemp("model") / "m.onnx"
    path.write_bytes(field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 17)))
    return str(path), table


def expected(texts, table, size, prefix="search_document: "):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    out = []
    for x in texts:
        v = table[t.encode(prefix + (x or "")).ids[:512]].astype(float).mean(axis=0)[:size]
        out.append(v / np.linalg.norm(v))
    return np.array(out)


def test_onnx_embedder(model):
    texts = ["one two three", "a", "", "longer words " * 400]
    got = vector.OnnxEmbedder(model[0], TOKENIZER, 4).embed_batch(texts)
    assert np.allclose(got, expected(texts, model[1], 4), atol=1e-5) and vector.OnnxEmbedder(model[0], TOKENIZER, 4).embed_batch([]).shape == (0, 4)
    with pytest.raises(ValueError, match="fewer than 7"):
        vector.OnnxEmbedder(model[0], TOKENIZER, 7).embed_batch(texts)


def test_onnx_embedder_as_a_column_and_warm(spark, model):
    ship(spark)
    make = lambda path=model[0]: vector.OnnxEmbedder(path, TOKENIZER, 4)
    texts = ["some words", None, "others"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = [r["v"] for r in df.select("i", vector.embed_column(make, F.col("t")).alias("v")).orderBy("i").collect()]
    assert np.allclose(np.array(got), expected(texts, model[1], 4), atol=1e-5)
    ready = api.Readiness()
    assert ready.warm(spark, make) and ready.backend == "OnnxEmbedder"


def test_pooling():
    hidden = np.arange(12, dtype=float).reshape(2, 3, 2)
    assert vector.mean_pool(hidden, np.array([[1, 1, 0], [0, 0, 0]])).tolist() == [[1.0, 2.0], [0.0, 0.0]]
    assert np.allclose(vector.unit_rows(np.array([[3.0, 4.0, 9.0], [0.0, 0.0, 1.0]]), 2), [[0.6, 0.8], [0.0, 0.0]])


def test_batches_keep_to_their_bucket():
    sizes = np.array([10] * 20 + [600] * 3 + [5000] * 2 + [512, 513])
    calls = vector.length_batches(sizes)
    assert sorted(np.concatenate(calls).tolist()) == list(range(len(sizes))) and max(map(len, calls)) == 16
    assert [sorted(set(np.searchsorted([512, 1024, 2048], sizes[c], "left").tolist())) for c in calls] == [[0], [0], [1], [3]]
    assert vector.length_batches(np.zeros(0)) == []

"""Vector expressions and embedders."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-12


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity in double precision; NaN for a zero vector, null for a null one."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale == 0, F.lit(float("nan"))).otherwise(1.0 - dot(a, b) / scale)


def cosine_to(column: str, query: list[float]) -> Column:
    """cosine_distance of an array column to one vector, unrolled: plain arithmetic on elements, which
    runs in generated code, where lambdas over arrays are interpreted. Null for another length.
    Written as one SQL text: a call to the JVM for each operator would take longer than the scan."""
    q = [float(x) for x in query]
    norm = float(np.sqrt(sum(x * x for x in q)))

    def total(terms: list[str]) -> str:
        # runs of a few terms, so that no single expression gets too deep
        while len(terms) > 1:
            terms = ["(" + " + ".join(terms[i : i + 16]) + ")" for i in range(0, len(terms), 16)]
        return terms[0] if terms else "0D"

    x = [f"cast(get(`{column}`, {i}) as double)" for i in range(len(q))]
    scale = f"sqrt({total([f'{v} * {v}' for v in x])}) * {norm!r}D"
    dot = total([f"{v} * ({p!r}D)" for v, p in zip(x, q)])
    return F.expr(f"case when size(`{column}`) = {len(q)} then case when {scale} = 0 then double('NaN') else 1D - {dot} / ({scale}) end end")


def nearest(base: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query, id, distance, rank): for each row of queries(id, embedding) the k rows of
    base(id, embedding) at the least cosine distance (rounded to 12 digits; ties by id).

    Both sides are packed into blocks of at most `block` vectors; each pair of blocks is one matrix
    product, of which the best k a query go on, so a query brings k rows a block and never a row
    a vector. Null ids, null and zero vectors and those of other lengths match nothing."""

    def pack(df: DataFrame, prefix: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, block):
                    part = batch.slice(lo, block)
                    v = part.column("embedding")
                    rows = np.array(v.flatten(), np.float64).reshape(part.num_rows, -1)
                    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                    fine = norm[:, 0] > 0
                    unit, ids = rows[fine] / norm[fine], part.column("id").to_numpy()[fine]
                    yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary())], [f"{prefix}_ids", f"{prefix}_unit"])

        typed = df.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("n"))
        whole = typed.filter((F.col("n") == size) & F.col("id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).select("id", "embedding")
        return whole.mapInArrow(run, f"{prefix}_ids binary, {prefix}_unit binary")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, asked = np.frombuffer(row["b_ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                if not len(ids) or not len(asked):
                    continue
                b, q = np.frombuffer(row["b_unit"]).reshape(len(ids), -1), np.frombuffer(row["q_unit"]).reshape(len(asked), -1)
                order = np.argsort(ids, kind="stable")
                ids, d = ids[order], np.round(1.0 - q @ b[order].T, 12)
                top = np.argsort(d, axis=1, kind="stable")[:, :k]
                n = top.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(asked, n)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(d, top, axis=1).ravel())], ["query", "id", "distance"]
                )

    size = (queries.select(F.max(F.size("embedding"))).first()[0] or 0)
    pairs = pack(base, "b").crossJoin(pack(queries, "q"))
    met = pairs.mapInArrow(best, "query long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def distance_to(query: list[float]) -> "callable":
    """A vectorised column function: cosine distance of an array column to one query vector. One
    matrix product for each Arrow batch; the higher-order form above runs interpreted instead."""
    q = np.asarray(query, np.float64)
    norm = float(np.sqrt((q * q).sum()))

    @F.pandas_udf(T.DoubleType())
    def distance(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        valid = np.flatnonzero([v is not None and len(v) == len(q) for v in vectors])
        if len(valid):
            m = np.stack(vectors.iloc[valid].to_numpy()).astype(np.float64)
            scale = np.sqrt((m * m).sum(axis=1)) * norm
            with np.errstate(divide="ignore", invalid="ignore"):
                out[valid] = np.where(scale == 0, np.nan, 1.0 - m @ q / scale)
        result = pd.Series(out, dtype=object)
        result[[v is None for v in vectors]] = None
        return result.astype("Float64") if result.isna().all() else result

    return distance


def l2_normalise(v: Column) -> Column:
    """v at unit length. Bind a costly v to a lambda's variable first: v occurs twice here, and in
    a higher-order function that means for every element."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scaled = F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(EPSILON))))
    return F.element_at(scaled, 1)


def matryoshka(v: Column, size: int) -> Column:
    """The first `size` dimensions at unit length; shorter vectors fail, null stays null."""
    enough = F.when(v.isNull() | (F.size(v) >= size), F.slice(v, 1, size)).otherwise(F.raise_error(F.lit(f"a vector has fewer than {size} dimensions")))
    return F.element_at(F.transform(F.array(enough), l2_normalise), 1)


def stub_embedding(text: Column, size: int) -> Column:
    """A deterministic unit vector made from a text's hash, for runs without a model."""
    # in an array, so that it is taken once and not for each dimension; 48 bits, so that products fit
    hashed = F.array(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"))
    raw = F.flatten(F.transform(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.sin(h * (2 * i + 1) % (1 << 27) / 1e6))))
    unit = F.transform(F.array(raw), l2_normalise)
    return F.element_at(unit, 1)


class Embedder(Protocol):
    """What an embedding backend offers; it is made once in each Python worker."""

    dimensions: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A deterministic stand-in for a model: words hashed to signed dimensions, at unit length, so
    that texts with the same words are near each other."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dimensions] += 1.0 if h >> 31 else -1.0
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), EPSILON)


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors that the mask keeps: hidden (texts, tokens, dimensions), mask (texts,
    tokens). A text without tokens gets zeros."""
    weight = mask.astype(np.float64)[:, :, None]
    return (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1.0)


def unit_rows(vectors: np.ndarray, dimensions: int) -> np.ndarray:
    """The first `dimensions` of each row at unit length; zeros stay zeros."""
    if vectors.shape[1] < dimensions:
        raise ValueError(f"vectors have fewer than {dimensions} dimensions")
    cut = vectors[:, :dimensions]
    return cut / np.maximum(np.sqrt((cut * cut).sum(axis=1, keepdims=True)), EPSILON)


class OnnxEmbedder:
    """A text encoder in an ONNX file with inputs input_ids, attention_mask (and token_type_ids, if it
    asks for them) and token vectors as its first output; its tokenizer in a JSON file. Texts get
    the prefix of their task, are cut at `longest` tokens, padded to the longest of the batch,
    mean-pooled, cut to `dimensions` and brought to unit length."""

    def __init__(self, model: str, tokenizer: str, dimensions: int = 384, prefix: str = "search_document: ", longest: int = 512):
        import onnxruntime
        from tokenizers import Tokenizer

        self.dimensions, self.prefix = dimensions, prefix
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenizer.enable_truncation(longest)
        self.tokenizer.enable_padding()
        self.session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dimensions))
        found = self.tokenizer.encode_batch([self.prefix + t for t in texts])
        ids, mask = (np.array([getattr(x, name) for x in found], np.int64) for name in ("ids", "attention_mask"))
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        asked = {i.name: given[i.name] for i in self.session.get_inputs()}
        return unit_rows(mean_pool(self.session.run(None, asked)[0], mask), self.dimensions)


class SidecarEmbedder:
    """Placeholder for a model served beside the cluster; it can't be used yet."""

    dimensions = 384

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError("no embedding sidecar is configured")


BATCH, BUCKETS = 16, (128, 256, 512)  # texts of a call; tokens to which a padded model rounds up


def length_batches(sizes: np.ndarray, batch: int = BATCH, buckets: tuple[int, ...] = BUCKETS) -> list[np.ndarray]:
    """Places of texts in calls of `batch` at most, from short to long, none across two buckets (by
    an estimate of four characters a token)."""
    order = np.argsort(sizes, kind="stable")
    kind = np.searchsorted(np.array(buckets) * 4, sizes[order], "left")
    out = []
    for k in np.unique(kind):
        same = order[kind == k]
        out += [same[i : i + batch] for i in range(0, len(same), batch)]
    return out


def embed_column(make: "callable", text: Column) -> Column:
    """Embed a text column with the backend that make() gives, once a worker: texts of like length go
    together in small calls, so that a padded model wastes little, and each row gets its own vector
    back. A null text is embedded as an empty one."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = make()
        for texts in batches:
            out: list = [None] * len(texts)
            for places in length_batches(texts.str.len().fillna(0).to_numpy()):
                vectors = backend.embed_batch([texts.iloc[i] or "" for i in places])
                if len(vectors) != len(places):
                    raise ValueError("the backend gave another number of vectors than of texts")
                for i, v in zip(places, vectors):
                    out[i] = np.asarray(v, np.float32)
            yield pd.Series(out)

    return embed(text)

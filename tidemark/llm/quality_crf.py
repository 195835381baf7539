"""Quality classifier: a linear-chain CRF over lines, trained on labelled documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import crf
from tidemark.llm import textkernel as tk
from tidemark.llm.textstats import Stats
from tidemark.runtime import ship, table

TRAIN_DOCS = 4000  # labelled documents that the model is fitted on, at most
KEEP = 0.5
N_FEATURES = 39


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, ptr, length) of the lines that aren't blank; text i has lines ptr[i]:ptr[i+1].

    A line's features describe itself and the lines before and after it in its text."""
    s = Stats(col)
    keep = ~s.blank
    ptr = np.concatenate([[0], np.cumsum(keep)])[s.lines.ptr]
    c, w = np.maximum(s.chars, 1), np.maximum(s.words, 1)
    own = np.stack([
        np.log1p(s.chars) / 5, s.symbol / c * 10, s.pipe / w * 2, s.upper / np.maximum(s.upper + s.lower, 1) * 2, s.shout / w, s.digit / c * 4,
        s.echo / w * 2, s.function / w * 4, (s.upper + s.lower) / c, np.minimum(s.word_bytes / w, 30) / 5, s.ends.astype(float), s.repeated.astype(float),
    ], axis=1)[keep]
    n = len(own)
    inside = np.ones(n, bool)
    inside[ptr[:-1][np.diff(ptr) > 0]] = False
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n:
        before[1:], after[:-1] = own[:-1], own[1:]
        before[~inside] = 0
        last = ptr[1:][np.diff(ptr) > 0] - 1
        after[last] = 0
    first = ~inside
    final = np.zeros(n, bool)
    final[ptr[1:][np.diff(ptr) > 0] - 1] = True
    return np.column_stack([np.ones(n), own, before, after, first, final]), ptr, s.chars[keep]


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a CRF in which each line of a labelled document has the document's label.

    Fitted on `most` labelled documents at most, drawn by a hash of doc_id; without labels of both
    kinds the weights are zero, so that every line is as likely good as bad. Of several labels of
    a document the lowest counts, of several texts with one doc_id the one of the least hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    labelled = texts.join(F.broadcast(drawn), "doc_id")
    rows = labelled.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("quality").alias("quality"))
    # one task fits the model, so that the driver never holds the texts
    fitted = rows.repartition(1).mapInArrow(_fit_batches, "weight array<double>, pair array<double>").first()
    if fitted is None:
        return np.zeros(N_FEATURES), np.zeros((2, 2))
    return np.array(fitted["weight"]), np.array(fitted["pair"]).reshape(2, 2)


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = []
    for batch in batches:
        for part in tk.slices(batch, "text"):
            x, ptr, _ = line_features(part.column("text"))
            for doc, y, lo, hi in zip(part.column("doc_id").to_pylist(), part.column("quality").to_pylist(), ptr[:-1], ptr[1:]):
                docs.append((doc, y, x[lo:hi]))
    docs.sort(key=lambda d: d[0])
    label = np.concatenate([np.full(len(x), y, np.int64) for _, y, x in docs]) if docs else np.zeros(0, np.int64)
    if len(set(label.tolist())) < 2:
        return
    ptr = np.concatenate([[0], np.cumsum([len(x) for _, _, x in docs])])
    weight, pair = crf.fit(np.concatenate([x for _, _, x in docs]), ptr, label)
    yield pa.RecordBatch.from_arrays([pa.array([weight.tolist()]), pa.array([pair.ravel().tolist()])], ["weight", "pair"])


def _score_batches(weight: np.ndarray, pair: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                x, ptr, length = line_features(part.column("text"))
                good, _, _ = crf.forward_backward(x @ weight, ptr, pair)
                row = np.repeat(np.arange(part.num_rows), np.diff(ptr))
                mass = np.bincount(row, weights=length, minlength=part.num_rows)
                value = np.bincount(row, weights=length * good, minlength=part.num_rows) / np.maximum(mass, 1)
                others = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(value)], [*others, "quality"])

    return run


def classify(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, quality, keep) for every document: the mean of its lines' marginal probabilities
    of being good, weighted by their lengths in characters; kept from KEEP on.

    Lines are labelled by a linear-chain CRF on features of the line and its neighbours, trained on
    `labels` (doc_id, quality) over `known` (the documents by default), and the marginals come from
    forward-backward over all lines of a document.

    Null, empty and white-space-only texts have no line, quality 0 and aren't kept. Repeated rows
    and null doc_ids each give their row; texts of any length are read whole. Other columns are
    ignored; an empty table of documents gives no rows.
    """
    ship(docs.sparkSession)
    weight, pair = train(docs if known is None else known, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_score_batches(weight, pair), "doc_id long, quality double").withColumn("keep", F.col("quality") >= KEEP)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "labels"))


def _kept_batches(weight: np.ndarray, pair: np.ndarray) -> Callable:
    score = _score_batches(weight, pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [x.column("quality").to_numpy() for x in score(iter([batch.select(["text"])]))]
            yield batch.filter(pa.array(np.concatenate(value) >= KEEP)) if value else batch

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, in one pass, all columns along."""
    ship(spark)
    weight, pair = train(docs, table(spark, sf_dir, "labels"))
    return docs.mapInArrow(_kept_batches(weight, pair), docs.schema)

"""Benchmark decontamination: a prefix-filtered set join of benchmark items and documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import textkernel as tk
from tidemark.runtime import materialize, ship, table

SHINGLE = 3  # words
THRESHOLD = 0.6  # share of an item's distinct shingles that a window of its size must hold
VOCABULARY_LIMIT = 4_000_000  # distinct benchmark shingles that are sent to every worker
_MASK_BITS = 22


def _need(count: np.ndarray) -> np.ndarray:
    return np.ceil(THRESHOLD * count - 1e-9).astype(np.int64)


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            words = tk.Words(part.column("text"))
            hashes, at = words.windows(SHINGLE)
            row = words.row()[at]
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
            row, hashes = row[fresh], hashes[fresh]
            count = np.bincount(row, minlength=part.num_rows)
            width = np.maximum(np.diff(words.ptr) - SHINGLE + 1, 0)
            item = part.column("item_id").to_numpy(zero_copy_only=False)
            iid = part.column("iid").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item[row].astype(np.int64)), pa.array(iid[row].astype(np.int64)), pa.array(hashes.view(np.int64)), pa.array(count[row].astype(np.int32)), pa.array(width[row].astype(np.int32))],
                ["item_id", "iid", "shingle", "distinct", "width"],
            )


class _Known:
    """Membership of hashes in a sorted array, most misses by one table look-up."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.mask = np.zeros(1 << _MASK_BITS, bool)
        self.mask[known >> np.uint64(64 - _MASK_BITS)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.mask[hashes >> np.uint64(64 - _MASK_BITS)])
        if not len(self.known):
            return maybe[:0]
        at = np.searchsorted(self.known, hashes[maybe])
        at[at == len(self.known)] = 0
        return maybe[self.known[at] == hashes[maybe]]


def _dense(pos: np.ndarray, row: np.ndarray, need: int, width: int) -> np.ndarray:
    """Hits that lie among `need` hits of their row within `width` places: no other hit can be
    part of a match, whichever the item."""
    n = len(pos)
    keep = np.zeros(n, bool)
    if n >= need:
        tight = (row[need - 1 :] == row[: n - need + 1]) & (pos[need - 1 :] - pos[: n - need + 1] < width)
        edge = np.zeros(n + 1, np.int64)
        first = np.flatnonzero(tight)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + need, -1)
        keep = np.cumsum(edge)[:n] > 0
    return keep


def _hits(shared, need: int, width: int) -> Callable:
    """Rows (doc_id, tid, shingle, pos) of benchmark shingles in documents; and with a null doc_id
    (shingle, pos = number of documents that hold it), over every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(np.frombuffer(shared.value, np.uint64))
        spread = np.zeros(len(known.known), np.int64)
        names = ["doc_id", "tid", "shingle", "pos"]
        for batch in batches:
            for part in tk.slices(batch, "text"):
                words = tk.Words(part.column("text"))
                hashes, at = words.windows(SHINGLE)
                found = known.find(hashes)
                hashes, at = hashes[found], at[found]
                row = np.searchsorted(words.ptr, at, "right") - 1
                index = np.searchsorted(known.known, hashes)
                spread += np.bincount(np.unique(row * len(spread) + index) % max(len(spread), 1), minlength=len(spread)) if len(spread) else 0
                keep = _dense(at, row, need, width)
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)
                tid = part.column("tid").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(doc[row[keep]].astype(np.int64)), pa.array(tid[row[keep]].astype(np.int64)), pa.array(hashes[keep].view(np.int64)), pa.array((at - words.ptr[row])[keep])], names)
        seen = np.flatnonzero(spread)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.int64()), pa.nulls(len(seen), pa.int64()), pa.array(known.known[seen].view(np.int64)), pa.array(spread[seen])], names)

    return run


def _all_shingles(part: pa.RecordBatch) -> pa.RecordBatch:
    words = tk.Words(part.column("text"))
    hashes, at = words.windows(SHINGLE)
    row = words.row()[at]
    doc = part.column("doc_id").to_numpy(zero_copy_only=False)
    tid = part.column("tid").to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[row].astype(np.int64)), pa.array(tid[row].astype(np.int64)), pa.array(hashes.view(np.int64)), pa.array((at - words.ptr[row]).astype(np.int64))], ["doc_id", "tid", "shingle", "pos"]
    )


def _best_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most distinct shingles of the item within `width` places of the document."""
    for batch in batches:
        best = []
        for hits, width in zip(batch.column("hits").to_pylist(), batch.column("width").to_pylist()):
            hits.sort(key=lambda x: x["pos"])
            inside: dict[int, int] = {}
            most = low = 0
            for x in hits:
                inside[x["shingle"]] = inside.get(x["shingle"], 0) + 1
                while hits[low]["pos"] <= x["pos"] - width:
                    s = hits[low]["shingle"]
                    inside[s] -= 1
                    if not inside[s]:
                        del inside[s]
                    low += 1
                most = max(most, len(inside))
            best.append(most)
        names = ["doc_id", "tid", "item_id", "distinct"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(best, pa.int32())], [*names, "shared"])


def _matches(docs: DataFrame, benchmark: DataFrame, vocabulary_limit: int) -> DataFrame:
    """(doc_id, tid, item_id, containment) for each text, told by doc_id and a hash (tid), and item."""
    spark = docs.sparkSession
    ship(spark)
    row = ["doc_id", "tid"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    texts = texts.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    source = source.select("item_id", F.xxhash64("text").alias("iid"), "text")
    items = materialize(source.mapInArrow(_item_batches, "item_id long, iid long, shingle long, distinct int, width int").distinct(), "items")
    facts = items.agg(F.countDistinct("shingle").alias("n"), F.min(F.ceil(F.col("distinct") * THRESHOLD - 1e-9)).alias("need"), F.max("width").alias("width")).first()
    schema = "doc_id long, tid long, shingle long, pos long"
    if facts["n"] <= vocabulary_limit:
        known = np.sort(np.array([r[0] for r in items.select("shingle").distinct().collect()], np.int64).view(np.uint64))
        shared = spark.sparkContext.broadcast(known.tobytes())
        found = materialize(texts.mapInArrow(_hits(shared, int(facts["need"] or 1), int(facts["width"] or 1)), schema), "hits")
        hits = found.filter("doc_id is not null")
        spread = found.filter("doc_id is null").groupBy("shingle").agg(F.sum("pos").alias("spread"))
    else:
        every = texts.mapInArrow(tk.mapper(_all_shingles, "text"), schema)
        hits = materialize(every.join(items.select("shingle").distinct(), "shingle", "left_semi").select(*row, "shingle", "pos"), "hits")
        spread = hits.groupBy("shingle").agg(F.count_distinct(*row).alias("spread"))
    item = ["item_id", "iid", "distinct", "width"]
    rarity = Window.partitionBy(*item).orderBy(F.coalesce("spread", F.lit(0)), "shingle")
    ranked = items.join(spread, "shingle", "left").withColumn("rank", F.row_number().over(rarity)).withColumn("need", F.ceil(F.col("distinct") * THRESHOLD - 1e-9))
    prefix = ranked.filter(F.col("rank") <= F.col("distinct") - F.col("need") + 1).select(*item, "shingle", "need")
    length = hits.groupBy(*row).agg(F.count("*").alias("n_hits"))
    pairs = hits.join(prefix, "shingle").join(length, row).filter("n_hits >= need").groupBy(*row, *item).agg(F.collect_set("pos").alias("at"))
    near = F.exists("at", lambda p: F.abs(p - F.col("pos")) < F.col("width"))
    shared_hits = hits.join(pairs, row).join(items, [*item, "shingle"]).filter(near)
    grouped = shared_hits.groupBy(*row, *item).agg(F.collect_set(F.struct("pos", "shingle")).alias("hits"))
    enough = grouped.filter(F.size("hits") >= F.col("distinct") * THRESHOLD - 1e-9)
    windows = enough.mapInArrow(_best_window, "doc_id long, tid long, item_id long, distinct int, shared int")
    return windows.filter(F.col("shared") >= F.col("distinct") * THRESHOLD - 1e-9).select(*row, "item_id", (F.col("shared") / F.col("distinct")).alias("containment"))


def contamination(docs: DataFrame, benchmark: DataFrame, vocabulary_limit: int = VOCABULARY_LIMIT) -> DataFrame:
    """Documents that hold benchmark items: (doc_id, item_id, containment), a row for each pair in
    which some window of the document, as long as the item, holds at least THRESHOLD of the item's
    distinct SHINGLE-word shingles; containment is the largest share over the windows.

    Shingles are ordered by rarity, counted over all documents. An item with d distinct shingles
    of which ceil(THRESHOLD d) are needed must share one of its d - need + 1 rarest with a match,
    so only those prefixes join; shorter documents (length) and hits farther than an item from a
    prefix hit (position) are cut before the exact window count verifies each pair. The benchmark's
    shingles go to the workers if there are at most vocabulary_limit; else documents' shingles are
    joined to them by a shuffle, with the same result.

    Items of fewer than SHINGLE words, null texts and null ids match nothing. Each text is matched
    by itself: of several texts with one doc_id, or items with one item_id, the largest share counts;
    repeated rows change nothing. Texts of any length are read whole. Other columns are ignored;
    empty tables give no rows.
    """
    return _matches(docs, benchmark, vocabulary_limit).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows are told apart by doc_id and text."""
    hit = _matches(docs, table(spark, sf_dir, "benchmark"), VOCABULARY_LIMIT).select(F.col("doc_id").alias("hit_doc"), F.col("tid").alias("hit_tid")).distinct()
    at = (docs["doc_id"].cast("long") == F.col("hit_doc")) & (F.xxhash64(docs["text"].cast("string")) == F.col("hit_tid"))
    return docs.join(hit, at, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '{tk.WORD_SQL}') AS ws FROM documents
), iwords AS (
  SELECT item_id, regexp_extract_all(lower(text), '{tk.WORD_SQL}') AS ws FROM benchmark
), ishingles AS (
  SELECT item_id, len(ws) - {SHINGLE - 1} AS width, array_to_string(list_slice(ws, p + 1, p + {SHINGLE}), ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(len(ws) - {SHINGLE - 1})) AS p FROM iwords WHERE len(ws) >= {SHINGLE})
), items AS (
  SELECT DISTINCT item_id, width, s, count(DISTINCT s) OVER (PARTITION BY item_id) AS d FROM ishingles
), dshingles AS (
  SELECT doc_id, p, array_to_string(list_slice(ws, p + 1, p + {SHINGLE}), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(len(ws) - {SHINGLE - 1})) AS p FROM words WHERE len(ws) >= {SHINGLE})
), hits AS (
  SELECT d.doc_id, i.item_id, i.width, i.d, d.p, d.s FROM dshingles d JOIN items i ON i.s = d.s
), wins AS (
  SELECT a.doc_id, a.item_id, a.d, a.p, count(DISTINCT b.s) AS n
  FROM (SELECT DISTINCT doc_id, item_id, width, d, p FROM hits) a JOIN hits b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.p >= a.p AND b.p < a.p + a.width
  GROUP BY a.doc_id, a.item_id, a.d, a.p
)
SELECT doc_id, item_id, CAST(max(n) AS DOUBLE) / d AS containment FROM wins GROUP BY doc_id, item_id, d HAVING max(n) >= {THRESHOLD} * d - 1e-9
"""

"""Repeated passages: all word windows that occur twice or more, prefiltered by a count-min sketch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkernel as tk
from tidemark.llm.winnow import minima
from tidemark.runtime import materialize, ship, table

WINDOW = 50  # words
ANCHOR = 10  # words of an anchor; each window holds WINDOW - ANCHOR + 1 of them
DEPTH = 2  # rows of the sketch
SHARD_BITS = 20  # counters of a row of a sketch shard, as a power of two
PART_BYTES = 2 << 20  # text of a part of the corpus, on average
HOT = 20_000  # occurrences from which a window's places are aggregated before they are shuffled

_ROW_SEEDS = [np.uint64((0xD1B54A32D192ED03 * (2 * i + 1)) % (1 << 64)) for i in range(DEPTH)]
_SECOND = np.uint64(0x5851F42D4C957F2D)


def _anchors(words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, least, chosen, values): first word and least anchor hash of each window; the words
    whose anchor is the least of some window; the anchor hash of each word."""
    values = np.full(len(words.hash), np.uint64(0xFFFFFFFFFFFFFFFF))
    hashes, at = words.windows(ANCHOR)
    values[at] = np.maximum(hashes, 1)
    # a row of n words has n - ANCHOR + 1 anchors: shorten rows by the words that start none
    start, least, chosen = minima_of_rows(values, words.ptr, WINDOW - ANCHOR + 1)
    return start, least, np.flatnonzero(chosen), values


def minima_of_rows(values: np.ndarray, ptr: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As minima, for rows whose last ANCHOR - 1 places start no anchor."""
    count = np.maximum(np.diff(ptr) - ANCHOR + 1, 0)
    at = tk.ranges(ptr[:-1], count)
    start, least, chosen = minima(values[at], np.concatenate([[0], np.cumsum(count)]), size)
    mask = np.zeros(len(values), bool)
    mask[at[chosen]] = True
    return at[start], least, mask


def _anchor_rows(part: pa.RecordBatch) -> pa.RecordBatch:
    """(anchor, part, n): the chosen anchors of the texts and how often each is chosen in a part."""
    words = tk.Words(part.column("text"))
    _, _, chosen, values = _anchors(words)
    anchor, place = values[chosen], part.column("part").to_numpy()[words.row()[chosen]]
    order = np.lexsort((place, anchor))
    anchor, place = anchor[order], place[order]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(fresh)
    return pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(place[first]), pa.array(np.diff(np.append(first, len(anchor))))], ["anchor", "part", "n"])


def _cell(anchors: np.ndarray, row: int) -> np.ndarray:
    return (tk.mix(anchors ^ _ROW_SEEDS[row]) >> np.uint64(64 - SHARD_BITS)).astype(np.uint32)


def _partial_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A count-min sketch of one partition: for each shard and row the cells that aren't zero and
    their counts (up to HOT)."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    whole = pa.Table.from_batches(parts)
    shard, n = whole.column("shard").to_numpy(), whole.column("n").to_numpy()
    anchor = np.ascontiguousarray(whole.column("anchor").to_numpy()).view(np.uint64)
    for row in range(DEPTH):
        at, where = np.unique(shard.astype(np.int64) << SHARD_BITS | _cell(anchor, row), return_inverse=True)
        count = np.minimum(np.bincount(where, n), HOT).astype(np.uint16)
        of = at >> SHARD_BITS
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        cell = (at & ((1 << SHARD_BITS) - 1)).astype(np.uint32)
        for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(of[lo])], pa.int64()), pa.array([row], pa.int32()), pa.array([cell[lo:hi].tobytes()], pa.binary()), pa.array([count[lo:hi].tobytes()], pa.binary())], ["shard", "row", "cells", "counts"]
            )


def _merge_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sketches of a shard and row, summed: one bit a counter for two or more, and the cells
    that reach HOT. Rows come sorted by shard and row, so one shard is held at a time."""
    now, counter = None, None

    def done() -> pa.RecordBatch:
        more = np.packbits(counter > 1, bitorder="little").tobytes()
        hot = np.flatnonzero(counter >= HOT).astype(np.uint32).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([more], pa.binary()), pa.array([hot], pa.binary())], ["shard", "row", "more", "hot"])

    for batch in batches:
        for x in batch.to_pylist():
            if (x["shard"], x["row"]) != now:
                if now is not None:
                    yield done()
                now, counter = (x["shard"], x["row"]), np.zeros(1 << SHARD_BITS, np.uint16)
            at = np.frombuffer(x["cells"], np.uint32)
            counter[at] = np.minimum(counter[at] + np.frombuffer(x["counts"], np.uint16), HOT)
    if now is not None:
        yield done()


def _runs_of(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of runs of rows that are equal in all columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    cuts = np.flatnonzero(new).tolist()
    return list(zip(cuts, [*cuts[1:], len(new)]))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, anchor, hot) of the anchors that their shard's sketch counts twice or more. A shard's
    sketch comes before its anchors (late)."""
    now, more, hot = None, {}, {}
    for batch in batches:
        shard, late = batch.column("shard").to_numpy(), batch.column("late").to_numpy(zero_copy_only=False)
        for lo, hi in _runs_of(shard, late):
            if shard[lo] != now:
                now, more, hot = shard[lo], {}, {}
            part = batch.slice(lo, hi - lo)
            if not late[lo]:
                for x in part.select(["row", "more", "hot"]).to_pylist():
                    more[x["row"]] = np.frombuffer(x["more"], np.uint8)
                    hot[x["row"]] = np.frombuffer(x["hot"], np.uint32)
                continue
            anchor = np.ascontiguousarray(part.column("anchor").to_numpy()).view(np.uint64)
            keep, often = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
            for row in range(DEPTH):
                cell = _cell(anchor, row)
                keep &= (more[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                often &= np.isin(cell, hot[row]) if len(hot[row]) else False
            yield pa.RecordBatch.from_arrays([part.column("part").filter(pa.array(keep)), pa.array(anchor[keep].view(np.int64)), pa.array(often[keep])], ["part", "anchor", "hot"])


def _window_runs(part: pa.RecordBatch, known: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    """Runs of windows in a row with one known anchor: anchor, document, place of the first window,
    the windows' 128-bit hashes (all first halves, then all second ones), and whether the anchor is
    hot. A place holds 31 bits that tell texts with one doc_id apart, then the first word's number."""
    words = tk.Words(part.column("text"))
    _, least, _, _ = _anchors(words)
    slot = np.minimum(np.searchsorted(known, least), max(len(known) - 1, 0))
    keep = known[slot] == least if len(known) else np.zeros(len(least), bool)
    h, at = words.windows(WINDOW)
    g = tk.windows(tk.mix(words.hash ^ _SECOND), words.ptr, WINDOW)[0][keep] if keep.any() else h[keep]
    h, at, least, slot = h[keep], at[keep], least[keep], slot[keep]
    row = np.searchsorted(words.ptr, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    doc = part.column("doc_id").to_numpy(zero_copy_only=False)[row[first]].astype(np.int64)
    tid = (part.column("tid").to_numpy(zero_copy_only=False)[row[first]].astype(np.int64) >> 33) & 0x7FFFFFFF
    place = tid << 32 | (at[first] - words.ptr[row[first]])
    # both halves of a run side by side: run i has its 16 * size[i] bytes at 16 * first[i]
    data = np.empty(2 * len(at), np.uint64)
    within = np.arange(len(at)) - np.repeat(first, size)
    base = np.repeat(2 * first, size) + within
    data[base], data[base + np.repeat(size, size)] = h, g
    ends = np.concatenate([[0], 16 * np.cumsum(size)]).astype(np.int32)
    hashes = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(least[first].view(np.int64)), pa.array(doc), pa.array(place), hashes, pa.array(often[slot[first]])], ["anchor", "doc_id", "place", "hashes", "hot"])


def _suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows with suspected anchors. A part's anchors come before its texts."""
    now, gathered, known, often = None, [], None, None
    for batch in batches:
        of, late = batch.column("part").to_numpy(), batch.column("late").to_numpy(zero_copy_only=False)
        for lo, hi in _runs_of(of, late):
            if of[lo] != now:
                now, gathered, known = of[lo], [], None
            part = batch.slice(lo, hi - lo)
            if not late[lo]:
                gathered.append((part.column("anchor").to_numpy(), part.column("hot").to_numpy(zero_copy_only=False)))
                continue
            if known is None:
                known = np.concatenate([x for x, _ in gathered]).view(np.uint64) if gathered else np.zeros(0, np.uint64)
                order = np.argsort(known)
                known, often = known[order], np.concatenate([x for _, x in gathered]).astype(bool)[order] if gathered else np.zeros(0, bool)
            for piece in tk.slices(part, "text") if len(known) else ():
                rows = _window_runs(piece, known, often)
                if rows.num_rows:
                    yield rows


def _unpacked(runs: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h, g, doc, place) of each window in runs."""
    hashes = runs.column("hashes")
    hashes = hashes.combine_chunks() if isinstance(hashes, pa.ChunkedArray) else hashes
    size = pc.binary_length(hashes).to_numpy(zero_copy_only=False).astype(np.int64) // 16
    data = np.frombuffer(b"".join(hashes.to_pylist()), np.int64)
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    base = np.repeat(2 * first, size) + within
    doc, place = (np.repeat(runs.column(c).to_numpy(), size) for c in ("doc_id", "place"))
    return data[base], data[base + np.repeat(size, size)], doc, place + within


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs as one row a window."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpacked(batch)], ["h", "g", "doc_id", "place"])


def _pieces(doc: np.ndarray, place: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
    """Repeated windows to runs of neighbours: (doc_id, place of the first, place of the last, how
    many are later)."""
    order = np.lexsort((later, place, doc))
    doc, place, later = doc[order], place[order], later[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    count = np.add.reduceat(later.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(place[first]), pa.array(place[last]), pa.array(count)], ["doc_id", "place", "until", "later"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that are here twice or more, as runs; a partition holds all windows of its anchors."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    h, g, doc, place = _unpacked(pa.Table.from_batches(parts))
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[order][1:] == h[order][:-1]
    order = order[same[1:] | same[:-1]]
    h, g, doc, place = h[order], g[order], doc[order], place[order]
    order = np.lexsort((place, doc, g, h))
    h, g, doc, place = h[order], g[order], doc[order], place[order]
    later = np.zeros(len(h) + 1, bool)
    later[1:-1] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    again = later[:-1] | later[1:]
    yield _pieces(doc[again], place[again], later[:-1][again])


def _hot_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _pieces(batch.column("doc_id").to_numpy(), batch.column("place").to_numpy(), batch.column("later").to_numpy(zero_copy_only=False))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows of whole documents to maximal runs of words that windows cover."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    whole = pa.Table.from_batches(parts)
    doc, place, until, later = (whole.column(c).to_numpy() for c in ("doc_id", "place", "until", "later"))
    order = np.lexsort((until, place, doc))
    doc, place, until, later = doc[order], place[order], until[order], later[order]
    # runs may overlap where a document's rows are repeated: look back to the farthest end so far
    one = np.cumsum(np.concatenate([[True], doc[1:] != doc[:-1]]))
    rank = np.unique(until, return_inverse=True)[1].astype(np.int64)
    far = np.maximum.accumulate(one.astype(np.int64) * (len(until) + 1) + rank)
    reach = np.unique(until)[far - one * (len(until) + 1)]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (place[1:] > reach[:-1] + WINDOW)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    start, end = place[first] & 0xFFFFFFFF, (reach[last] & 0xFFFFFFFF) + WINDOW
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc[first]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.add.reduceat(later, first))], ["doc_id", "start_word", "end_word", "later_windows"]
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Word runs covered by windows of WINDOW words that occur more than once in the corpus:
    (doc_id, start_word, end_word, later_windows). Words count from 0; end_word is exclusive;
    later_windows counts the run's windows that aren't the first of their kind by (doc_id, word).

    Pass one chooses in each window the least of its ANCHOR-word hashes and counts the chosen
    anchors in a count-min sketch: sparse sketches of partitions, merged shard by shard. Equal
    windows choose equal anchors and the sketch never counts too low, so a repeated window's anchor
    always shows two or more. Anchors are probed in their shard's task, and those that pass go back
    to the part of the corpus that has them, once a part. Pass two sends only windows with such an
    anchor to an exact grouping by 128 bits of window hash, so none is lost and false alarms of the
    sketch vanish; they travel in runs that share an anchor, to the task of that anchor. The sketch
    is never sent to the driver or broadcast, at any size of the corpus. Windows whose anchor the
    sketch counts HOT times are dealt out to all tasks, aggregated before they are shuffled, and
    joined with their first place.

    Null texts and texts of fewer than WINDOW words have no windows; rows with a null doc_id are
    left out. Repeated rows count as separate occurrences, in runs that they share; different texts
    with one doc_id have runs of their own, ordered by a hash of the text. Texts of any length are
    read whole. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    texts = texts.filter(F.length("text") >= 2 * WINDOW - 1)  # shorter ones can't hold a window
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about one word in 6 bytes and a chosen anchor in 20 words; four counters an anchor and row
    shards = max(1, int(total / 120 * 4) >> SHARD_BITS)
    parts = max(spark.sparkContext.defaultParallelism, int(total) // PART_BYTES)
    told = texts.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    dealt = told.withColumn("part", F.pmod(F.xxhash64("doc_id", "tid"), F.lit(parts)).cast("int"))
    chosen = dealt.mapInArrow(tk.mapper(_anchor_rows, "text"), "anchor long, part int, n long")
    once = chosen.groupBy("anchor", "part").agg(F.sum("n").alias("n"))
    anchors = materialize(once.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))), "anchors")
    partial = anchors.mapInArrow(_partial_sketches, "shard long, row int, cells binary, counts binary")
    sketch = materialize(partial.repartition("shard").sortWithinPartitions("shard", "row").mapInArrow(_merge_sketches, "shard long, row int, more binary, hot binary"), "sketch")
    both = sketch.withColumn("late", F.lit(False)).unionByName(anchors.select("shard", "anchor", "part", F.lit(True).alias("late")), allowMissingColumns=True)
    suspects = materialize(both.repartition("shard").sortWithinPartitions("shard", "late").mapInArrow(_probe, "part int, anchor long, hot boolean"), "suspects")
    met = suspects.withColumn("late", F.lit(False)).unionByName(dealt.withColumn("late", F.lit(True)), allowMissingColumns=True)
    ordered = met.repartition("part").sortWithinPartitions("part", "late")
    runs = ordered.mapInArrow(_suspected, "anchor long, doc_id long, place long, hashes binary, hot boolean")
    # one shuffle serves both: an anchor's windows to one task, those of hot anchors to any
    dealt_runs = runs.repartition(F.when(F.col("hot"), F.xxhash64("doc_id", "place")).otherwise(F.col("anchor")))
    columns = ["doc_id", "place", "hashes"]
    piece = "doc_id long, place long, until long, later long"
    pieces = dealt_runs.filter("not hot").select(*columns).mapInArrow(_repeats, piece)
    if not suspects.filter("hot").isEmpty():
        hot = dealt_runs.filter("hot").select(*columns).mapInArrow(_windows, "h long, g long, doc_id long, place long")
        first = hot.groupBy("h", "g").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        later = F.struct("doc_id", "place") > F.col("first")
        pieces = pieces.unionByName(hot.join(first, ["h", "g"]).select("doc_id", "place", later.alias("later")).mapInArrow(_hot_pieces, piece))
    by_text = pieces.withColumn("text_bits", F.shiftright("place", 32))
    return by_text.repartition("doc_id", "text_bits").mapInArrow(_spans, "doc_id long, start_word int, end_word int, later_windows long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents", spread=True))


SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '{tk.WORD_SQL}') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), starts AS (
  SELECT doc_id, ws, unnest(range(len(ws) - {WINDOW - 1})) AS p FROM words WHERE len(ws) >= {WINDOW}
), win AS (
  SELECT doc_id, p, md5(array_to_string(list_slice(ws, p + 1, p + {WINDOW}), ' ')) AS h FROM starts
), marked AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM win
), repeats AS (
  SELECT doc_id, p, k, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM marked WHERE n > 1
), islands AS (
  SELECT doc_id, p, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM repeats
)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + {WINDOW} AS INTEGER) AS end_word,
       CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS later_windows
FROM islands GROUP BY doc_id, island
"""

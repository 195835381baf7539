"""Line dedup: runs of lines that occurred before, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkernel as tk
from tidemark.llm.winnow import minima
from tidemark.runtime import materialize, ship, table

RUN = 3  # lines of the shortest run that counts as repeated, whatever their length
LONG_WORDS = 50  # words from which a run of fewer lines counts too
_SIDE = RUN - 1
_AROUND = [f"l{i}" for i in range(2 * _SIDE + 1)]


def _postings(part: pa.RecordBatch) -> pa.RecordBatch:
    """Fingerprints with the hashes of the lines around them: for runs of RUN lines each line whose
    hash is the least of some RUN lines in a row (lines = RUN), for shorter runs of LONG_WORDS words
    or more the least line of each (lines = length of the run, at = place of its first line)."""
    lines = tk.Lines(part.column("text"))
    solid = ~lines.blank
    value = np.maximum(lines.hashes()[solid], 1)
    words = lines.words()[solid]
    ptr = np.concatenate([[0], np.cumsum(solid)])[lines.ptr]
    n = len(value)
    row = np.repeat(np.arange(part.num_rows), np.diff(ptr))
    _, _, chosen = minima(value, ptr, RUN)
    marks, starts, sizes = [np.flatnonzero(chosen)], [np.flatnonzero(chosen)], [np.full(int(chosen.sum()), RUN)]
    for size in range(1, RUN):
        first = np.flatnonzero(row[: max(n - size + 1, 0)] == row[size - 1 :]) if n else np.zeros(0, np.int64)
        total = sum((words[first + i] for i in range(size)), np.zeros(len(first), np.int64))
        first = first[total >= LONG_WORDS]
        run = np.column_stack([value[first + i] for i in range(size)]) if len(first) else np.zeros((0, size), np.uint64)
        marks.append(first + run.argmin(axis=1) if len(first) else first)
        starts.append(first)
        sizes.append(np.full(len(first), size))
    mark, start, size = np.concatenate(marks), np.concatenate(starts), np.concatenate(sizes)
    around = []
    for d in range(-_SIDE, _SIDE + 1):
        near = np.clip(mark + d, 0, max(n - 1, 0))
        inside = (mark + d >= ptr[row[mark]]) & (mark + d < ptr[row[mark] + 1])
        around.append(np.where(inside, value[near], 0).view(np.int64))
    doc = part.column("doc_id").to_numpy(zero_copy_only=False)
    tid = part.column("tid").to_numpy(zero_copy_only=False)
    place = [mark - ptr[row[mark]], start - ptr[row[mark]], size]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[row[mark]].astype(np.int64)), pa.array(tid[row[mark]].astype(np.int64)), *(pa.array(x.astype(np.int32)) for x in place), *(pa.array(x) for x in around)],
        ["doc_id", "tid", "pos", "at", "lines", *_AROUND],
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints that occur more than once, extended both ways to the runs that they are the
    least line of: a key of the run's lines, and where it starts."""
    for batch in batches:
        pos, at, lines = (batch.column(c).to_numpy() for c in ("pos", "at", "lines"))
        around = np.column_stack([batch.column(c).to_numpy() for c in _AROUND]).view(np.uint64)
        mark = around[:, _SIDE]
        keys, rows, starts = [], [], []
        for size in range(1, RUN + 1):
            for left in range(size):  # lines of the run before the fingerprint
                run = around[:, _SIDE - left : _SIDE - left + size]
                own = (lines == size) & (run > 0).all(axis=1) & (run.min(axis=1) == mark)
                if size < RUN:
                    own &= pos - left == at
                h = np.full(int(own.sum()), size, np.uint64)
                for i in range(size):
                    h = tk.mix(h * np.uint64(0x9E3779B97F4A7C15) + run[own, i])
                keys.append(h)
                rows.append(np.flatnonzero(own))
                starts.append((pos[own] - left).astype(np.int64) << 2 | size)
        row = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), batch.column("doc_id").take(row), batch.column("tid").take(row), pa.array(np.concatenate(starts))], ["run", "doc_id", "tid", "start"]
        )


def _cut(text: str, starts: list[int]) -> tuple[str, int]:
    gone = {(s >> 2) + i for s in starts for i in range(s & 3)}
    kept, at, cut = [], -1, 0
    for line in text.split("\n"):
        if line.strip(" \t\r"):
            at += 1
            if at in gone:
                cut += 1
                continue
        kept.append(line)
    return "\n".join(kept), cut


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts = batch.column("starts")
        hit = np.flatnonzero(starts.is_valid().to_numpy(zero_copy_only=False))
        text = batch.column("text")
        removed = np.zeros(batch.num_rows, np.int32)
        if len(hit):
            texts = text.to_pylist()
            for i in hit.tolist():
                if texts[i] is not None:
                    texts[i], removed[i] = _cut(texts[i], starts[i].as_py())
            text = pa.array(texts, text.type)
        names = batch.schema.names
        columns = [text if c == "text" else batch.column(c) for c in names if c != "starts"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], [*(c for c in names if c != "starts"), "removed_lines"])


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents without later repeated runs of lines, and removed_lines.

    A line is deleted if it lies in a run of lines that occurred before: of RUN lines, or of fewer
    with LONG_WORDS words or more between white space (blank lines don't count). Before means in a
    document of lower doc_id, or earlier in its own. Lines compare without white space at their
    ends. Fingerprints are the least line hashes of each RUN lines in a row and of each shorter run
    that is long enough, so each repeated run shares one with its earlier copy. Fingerprints that
    occur once are let go; the others' positions are extended both ways to runs, which are joined
    with the first place of the same run. Deleted runs that overlap make longer ones. Counts and
    first places are aggregated before they are shuffled, so a run that many documents share costs
    each task one row there.

    Rows are told apart by doc_id and text: different texts with one doc_id are documents of their
    own, in the order of a hash of their texts; repeated rows with both equal count as one document.
    Rows with null text or doc_id and texts that hold no such run stay as they are; a text of which
    all lines go becomes what blank lines it had. Texts of any length are read whole. An input
    column removed_lines is replaced; all others stay. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.drop("removed_lines")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    found = texts.select("doc_id", F.xxhash64("text").alias("tid"), "text").mapInArrow(tk.mapper(_postings, "text"), "doc_id long, tid long, pos int, at int, lines int, " + ", ".join(f"{c} long" for c in _AROUND))
    postings = materialize(found, "line_fingerprints")
    often = postings.groupBy(f"l{_SIDE}").count().filter("count > 1").select(f"l{_SIDE}")
    runs = materialize(postings.join(often, f"l{_SIDE}", "left_semi").select(*postings.columns).mapInArrow(_runs, "run long, doc_id long, tid long, start long"), "line_runs")
    first = runs.groupBy("run").agg(F.min(F.struct("doc_id", "tid", "start")).alias("first"), F.max(F.struct("doc_id", "tid", "start")).alias("last"))
    # a run whose first and last places are one, seen through equal lines, isn't repeated
    later = runs.join(first.filter("first <> last").select("run", "first"), "run").filter(F.struct("doc_id", "tid", "start") > F.col("first"))
    starts = later.groupBy(F.col("doc_id").alias("run_doc"), F.col("tid").alias("run_tid")).agg(F.collect_set("start").alias("run_starts"))
    # the input may have columns by any name: carry it as one struct
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest"))
    same = (row["doc_id"] == starts["run_doc"]) & (F.xxhash64(row["text"]) == starts["run_tid"])
    joined = row.join(starts, same, "left").select("text", "rest", F.col("run_starts").alias("starts"))
    schema = joined.drop("starts").schema.add("removed_lines", T.IntegerType())
    cut = joined.mapInArrow(_rewrite, schema)
    return cut.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns), "removed_lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs; those of which nothing is left are dropped, and
    n_chars follows the text."""
    cut = line_dedup(docs)
    left = cut.filter("removed_lines = 0 or text rlike '[^ \\t\\r\\n]'")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents
), solid AS (
  SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS p
  FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), runs AS (
  SELECT doc_id, p, t AS a, lead(t) OVER w AS b, lead(t, 2) OVER w AS c, len(string_split_regex(t, '[ \t\r]+')) AS wa, lead(len(string_split_regex(t, '[ \t\r]+'))) OVER w AS wb
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), later AS (
  SELECT doc_id, p, 3 AS size FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM runs WHERE b IS NOT NULL AND c IS NOT NULL) WHERE k > 1
  UNION ALL SELECT doc_id, p, 2 FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, p) AS k FROM runs WHERE b IS NOT NULL AND wa + wb >= {LONG_WORDS}) WHERE k > 1
  UNION ALL SELECT doc_id, p, 1 FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY a ORDER BY doc_id, p) AS k FROM runs WHERE wa >= {LONG_WORDS}) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, p + i AS p FROM later, (SELECT unnest([0, 1, 2]) AS i) WHERE i < size
), state AS (
  SELECT l.doc_id, l.n, l.line, g.p IS NOT NULL AS cut FROM lines l LEFT JOIN solid s ON s.doc_id = l.doc_id AND s.n = l.n LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.p = s.p
)
SELECT doc_id, coalesce(string_agg(CASE WHEN NOT cut THEN line END, chr(10) ORDER BY n), '') AS text, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) AS INTEGER) AS removed_lines
FROM state GROUP BY doc_id
"""

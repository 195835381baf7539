"""Token ids of a corpus as compressed binary blocks."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import rans
from tidemark.llm import textkernel as tk
from tidemark.runtime import materialize, ship, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Cuts text before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 1 << 20  # tokens from which a block is full
NULL = -1  # length of a document whose text is null

_BLOCK = (
    "block_id long, n_tokens int, doc_ids array<long>, lengths array<int>, stream binary, "
    "checkpoints array<struct<place:long,states:binary,checksum:long>>"
)
_encoders: dict[int, object] = {}


def encoder(data: bytes):
    """The worker's tiktoken encoding for a rank file's bytes, and its number of tokens."""
    import tiktoken

    key = hash(data)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encoders[key] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
    return _encoders[key]


def _tokenise(shared) -> Callable:
    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        encoding, _ = encoder(shared.value)
        ids = [None if t is None else np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return tk.mapper(one, "text")


def _count(vocabulary: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for part in tk.slices(batch, "ids", 8 << 20):
                flat = np.frombuffer(b"".join(x for x in part.column("ids").to_pylist() if x), "<u4")
                total += np.bincount(flat, minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["token", "n"])

    return run


def _encode_blocks(shared) -> Callable:
    def block(docs: list[int | None], ids: list[bytes | None], freq: rans.Table) -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(x for x in ids if x), "<u4").astype(np.int64)
        b = rans.encode(tokens, freq)
        row = {
            "block_id": next((d for d in docs if d is not None), None),
            "n_tokens": b.tokens,
            "doc_ids": docs,
            "lengths": [NULL if x is None else len(x) // 4 for x in ids],
            "stream": b.stream,
            "checkpoints": [{"place": p, "states": s, "checksum": c} for p, s, c in zip(b.places, b.states, b.checksums)],
        }
        kind = pa.struct([("place", pa.int64()), ("states", pa.binary()), ("checksum", pa.int64())])
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(kind)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = rans.Table.of(np.frombuffer(shared.value, np.int64))
        docs, ids, size = [], [], 0
        for batch in batches:
            for part in tk.slices(batch, "ids", 4 * BLOCK_TOKENS):
                for doc, x in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist()):
                    docs.append(doc)
                    ids.append(x)
                    size += len(x) // 4 if x else 0
                    if size >= BLOCK_TOKENS:
                        yield block(docs, ids, freq)
                        docs, ids, size = [], [], 0
        if docs:
            yield block(docs, ids, freq)

    return run


def encode(docs: DataFrame, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(blocks, frequencies) of the token ids of all documents.

    Texts become ids by byte-pair encoding with a rank file. Frequencies (token, freq) come from
    the counts over all documents, scaled to 2^20; every block is coded with them by a static range
    asymmetric numeral system and decodes by itself. A block holds whole documents, BLOCK_TOKENS
    tokens or somewhat more (fewer at a partition's end): their doc_ids and lengths, the stream of
    its interleaved lanes, and a checkpoint every 256 steps from which the segment decodes alone
    and proves itself by its CRC-32. block_id is the first doc_id that isn't null.

    A null text has length NULL, an empty one length 0. Repeated rows, null doc_ids and texts
    longer than a block are kept as they are; other columns are ignored; an empty table gives no
    block and flat frequencies.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(ranks if os.path.exists(ranks) else SparkFiles.get(ranks), "rb") as f:
        data = f.read()
    _, vocabulary = encoder(data)
    model = spark.sparkContext.broadcast(data)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = materialize(texts.mapInArrow(_tokenise(model), "doc_id long, ids binary"), "token_ids")
    counted = tokens.select("ids").mapInArrow(_count(vocabulary), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for token, n in counted:
        counts[token] = n
    freq = rans.scale(counts)
    blocks = tokens.mapInArrow(_encode_blocks(spark.sparkContext.broadcast(freq.tobytes())), _BLOCK)
    frequencies = spark.createDataFrame(pa.table({"token": np.arange(vocabulary, dtype=np.int32), "freq": freq}))
    return blocks, frequencies


def _decode_blocks(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = rans.Table.of(np.frombuffer(shared.value, np.int64))
        for batch in batches:
            for x in batch.to_pylist():
                points = x["checkpoints"]
                b = rans.Block(x["n_tokens"], x["stream"], [p["place"] for p in points], [p["states"] for p in points], [p["checksum"] for p in points])
                parts = [rans.decode_segment(b, freq, i) for i in range(len(points))]
                tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                sizes = np.array(x["lengths"], np.int64)
                ends = np.cumsum(np.maximum(sizes, 0))
                ids = [None if n == NULL else tokens[e - n : e].astype(np.int32) for n, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_ids"], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def decode(blocks: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents in blocks; a segment that fails its checksum is an error.
    Blocks decode in parallel, each with nothing but itself and the frequencies."""
    spark = blocks.sparkSession
    ship(spark)
    return blocks.mapInArrow(_decode_blocks(spark.sparkContext.broadcast(_frequency_bytes(frequencies))), "doc_id long, ids array<int>")


def segments(blocks: DataFrame) -> DataFrame:
    """(block_id, segment, n, states, checksum, stream): the segments of all blocks as rows of their
    own, each with its checkpoint and no more of the stream than it reads."""
    at = F.col("checkpoints")[F.col("segment")]["place"]
    until = F.coalesce(F.get(F.col("checkpoints"), F.col("segment") + 1)["place"], F.octet_length("stream") / 4).cast("int")
    size = rans.SEGMENT_STEPS * rans.LANES
    each = blocks.select("block_id", "n_tokens", "stream", "checkpoints", F.posexplode("checkpoints").alias("segment", "point"))
    return each.select(
        "block_id", "segment", F.least(F.lit(size), F.col("n_tokens") - F.col("segment") * size).cast("int").alias("n"), "point.states", "point.checksum",
        F.substr(F.col("stream"), (at * 4 + 1).cast("int"), (until - at.cast("int")) * 4).alias("stream"),
    )


def decode_segments(blocks: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(block_id, segment, ids): the tokens of each segment. Segments are dealt out to all tasks, so
    those of one block decode in parallel; one that fails its checksum is an error."""
    spark = blocks.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(_frequency_bytes(frequencies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = rans.Table.of(np.frombuffer(shared.value, np.int64))
        for batch in batches:
            for x in batch.to_pylist():
                ids = rans.decode_segment(rans.Block(x["n"], x["stream"], [0], [x["states"]], [x["checksum"]]), freq, 0)
                yield pa.RecordBatch.from_arrays([pa.array([x["block_id"]], pa.int64()), pa.array([x["segment"]], pa.int32()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["block_id", "segment", "ids"])

    dealt = segments(blocks).repartition(spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "block_id long, segment int, ids array<int>")


def _frequency_bytes(frequencies: DataFrame) -> bytes:
    return np.array([r["freq"] for r in frequencies.orderBy("token").select("freq").collect()], np.int64).tobytes()


def stored(blocks: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One table that decodes by itself: the blocks, and a header row (no tokens, no documents) whose
    column `frequencies` holds the shared table as 64-bit numbers by token."""
    spark = blocks.sparkSession
    data = _frequency_bytes(frequencies)
    schema = blocks.schema.add("frequencies", "binary")
    header = spark.createDataFrame([(-1, 0, [], [], bytearray(), [], bytearray(data))], schema)
    return header.unionByName(blocks.withColumn("frequencies", F.lit(None).cast("binary")))


def load(table_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, frequencies) of a stored table."""
    header = table_.filter("frequencies is not null").first()
    freq = np.frombuffer(header["frequencies"], np.int64)
    frequencies = table_.sparkSession.createDataFrame(pa.table({"token": np.arange(len(freq), dtype=np.int32), "freq": freq}))
    return table_.filter("frequencies is null").drop("frequencies"), frequencies


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks, and the frequencies that they share in a header row."""
    return stored(*encode(table(spark, sf_dir, "documents", spread=True)))

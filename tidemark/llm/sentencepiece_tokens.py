"""SentencePiece models on the tokenizers library: encoding, decoding and parity."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkernel as tk
from tidemark.runtime import ship, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2  # of a worker's encoder
CACHED = 400_000  # chunks that a worker remembers before it starts afresh
MARK = "▁"  # the metaspace marker
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: numbers as integers, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    marker_last: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    """The model in a protobuf file's bytes."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            m.pieces.append(x.get(1, b"").decode())
            m.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
            m.kinds.append(x.get(3, NORMAL))
        elif number == 2:
            x = dict(_fields(value))
            m.unigram, m.byte_fallback, m.marker_last = x.get(3, 1) == 1, bool(x.get(35, 0)), bool(x.get(24, 0))
            if x.get(3, 1) not in (1, 2):
                raise ValueError("only unigram and BPE models can be rebuilt")
        elif number == 3:
            x = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1))
    if USER in m.kinds or m.marker_last or not m.escape:
        raise ValueError("user-defined pieces, trailing markers and unescaped spaces aren't supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """BPE merges in the order in which the pieces' scores apply them."""
    ids = {p: i for i, p in enumerate(m.pieces)}
    ranked = []
    for p, s, k in zip(m.pieces, m.scores, m.kinds):
        if k == NORMAL and len(p) > 1:
            ranked += [(-s, ids[a], ids[b], a, b) for a, b in ((p[:i], p[i:]) for i in range(1, len(p))) if a in ids and b in ids]
    ranked.sort(key=lambda x: x[0])
    return [(a, b) for *_, a, b in ranked]


def build(m: Model):
    """(tokenizer for normalised text, tokenizer for raw text) of the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    def model():
        if m.unigram:
            return models.Unigram(list(zip(m.pieces, m.scores)), m.kinds.index(UNKNOWN), m.byte_fallback)
        return models.BPE({p: i for i, p in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[m.kinds.index(UNKNOWN)], fuse_unk=True, byte_fallback=m.byte_fallback)

    bare, full = Tokenizer(model()), Tokenizer(model())
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    full.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    full.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return bare, full


class Codec:
    """Encodes and decodes with one model. Texts are cut where no piece can reach across (before
    runs of the marker); each distinct chunk is encoded once, in multithreaded batches, and
    compared with the sentencepiece library and with its own decoding."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = parse(data)
        self.bare, self.full = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        whole = any(MARK in p.lstrip(MARK) for p, k in zip(self.model.pieces, self.model.kinds) if k == NORMAL)
        self.chunks = re.compile(".+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+", re.DOTALL).findall
        raw = [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(self.model.pieces, self.model.kinds)]
        self.piece_size = np.array([len(x) for x in raw], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.plain = not self.model.charsmap and not self.model.squeeze
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.size, self.same = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def normalise(self, text: str) -> str:
        if not self.plain:
            return self.full.normalizer.normalize_str(text)
        return (MARK if self.model.dummy_prefix and text else "") + text.replace(" ", MARK)

    def _learn(self, fresh: list[str]) -> None:
        ids = [x.ids for x in self.bare.encode_batch_fast(fresh, add_special_tokens=False)]
        cut = 1 if self.model.dummy_prefix else 0
        expected = self.reference.encode([c[cut:] if c.startswith(MARK) else c for c in fresh], num_threads=THREADS)
        self.code.update(zip(fresh, range(len(self.code), len(self.code) + len(fresh))))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
        self.size = np.concatenate([self.size, size])
        self.same = np.concatenate([self.same, np.fromiter(map(eq, ids, expected), bool, len(ids))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends, parity): text i has ids[ends[i-1]:ends[i]]; parity: the sentencepiece library
        gives the same ids.

        Merges never look beyond a chunk, so a BPE text whose chunks all encode alike does so too.
        Unigram scores add up over a whole text, where rounding and ties may fall otherwise than in
        a chunk by itself; those texts, and BPE texts with an odd chunk, are compared whole."""
        if len(self.code) > CACHED:
            self._reset()
        cut = [self.chunks(self.normalise(t)) for t in texts]
        known = self.code
        fresh = [c for c in dict.fromkeys(chain.from_iterable(cut)) if c not in known]
        if fresh:
            self._learn(fresh)
        count = np.array([len(x) for x in cut], np.int64)
        code = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, int(count.sum()))
        ids = self.flat[tk.ranges((np.cumsum(self.size) - self.size)[code], self.size[code])]
        ptr = np.concatenate([[0], np.cumsum(count)])
        sized = np.concatenate([[0], np.cumsum(self.size[code])])
        odd = np.concatenate([[0], np.cumsum(~self.same[code])])
        ends, parity = sized[ptr[1:]], odd[ptr[1:]] == odd[ptr[:-1]]
        unsure = np.arange(len(texts)) if self.model.unigram else np.flatnonzero(~parity)
        if len(unsure):
            expected = self.reference.encode([texts[i] for i in unsure], num_threads=THREADS)
            begin = np.concatenate([[0], ends[:-1]])
            for i, e in zip(unsure.tolist(), expected):
                parity[i] = np.array_equal(ids[begin[i] : ends[i]], np.array(e, np.int32))
        return ids, ends, parity

    def decode_bytes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ends) of the decoded texts, without the space of the dummy prefix."""
        data = self.piece_bytes[tk.ranges(self.piece_start[ids], self.piece_size[ids])]
        total = np.concatenate([[0], np.cumsum(self.piece_size[ids])])
        stop = total[ends]
        if self.model.dummy_prefix and len(ends):
            start = np.concatenate([[0], stop[:-1]])
            lead = start[stop > start]
            lead = lead[data[lead] == 32]
            keep = np.ones(len(data), bool)
            keep[lead] = False
            data = data[keep]
            stop = stop - np.searchsorted(lead, stop, "left")
        return data, stop


_codecs: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    """The worker's codec for a model, built once."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    key = hash(data)
    if key not in _codecs:
        _codecs[key] = Codec(data)
    return _codecs[key]


def _encode_batches(shared) -> Callable:
    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(shared.value)
        text = part.column("text")
        valid = text.is_valid()
        present = text.filter(valid)
        ids, ends, parity = c.encode(present.to_pylist())
        back, stop = c.decode_bytes(ids, ends)
        data, off = tk.buffers(present)
        exact = np.diff(np.concatenate([[0], stop])) == np.diff(off)
        if exact.all():
            wrong = np.concatenate([[0], np.cumsum(back != data)])
            exact = wrong[off[1:]] == wrong[off[:-1]]
        else:
            begin = np.concatenate([[0], stop[:-1]])
            exact = np.array([bool(e) and back[a:b].tobytes() == data[p:q].tobytes() for e, a, b, p, q in zip(exact, begin, stop, off[:-1], off[1:])], bool)
        place = pc.if_else(valid, pc.subtract(pc.cumulative_sum(valid.cast(pa.int32())), 1), None)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32()))
        sizes = pa.array(np.diff(np.concatenate([[0], ends])).astype(np.int32))
        columns = [lists, sizes, pa.array(parity), pa.array(exact)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(x.take(place) for x in columns)], ["doc_id", "ids", "n_tokens", "parity", "round_trip"])

    return tk.mapper(one, "text")


def _decode_batches(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            c = codec(shared.value)
            ids = [x if x is not None else [] for x in lists.to_pylist()]
            flat = np.fromiter((i for x in ids for i in x), np.int64)
            data, stop = c.decode_bytes(flat, np.cumsum([len(x) for x in ids], dtype=np.int64))
            begin = np.concatenate([[0], stop[:-1]])
            texts = [data[a:b].tobytes().decode("utf-8", "replace") if ok else None for a, b, ok in zip(begin, stop, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _shared_model(spark: SparkSession, model: str):
    """The model's bytes as a broadcast (its size is that of the vocabulary, not of the data)."""
    ship(spark)
    path = SparkFiles.get(model) if not os.path.exists(model) else model
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, parity, round_trip) for every document, by a SentencePiece model.

    The model file's protobuf is parsed and its normaliser, metaspace marker, scores (unigram) or
    merges (BPE) and byte fallback are rebuilt on the tokenizers library. parity: the sentencepiece
    library gives the text the same ids. round_trip: the ids decode to the very text.

    A null text gives nulls, an empty one no ids and true, true. Repeated rows and null doc_ids each
    give their row; texts of any length are encoded whole. Other columns are ignored; an empty table
    gives no rows.
    """
    shared = _shared_model(docs.sparkSession, model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_encode_batches(shared), "doc_id long, ids array<int>, n_tokens int, parity boolean, round_trip boolean")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text. Bytes that aren't valid
    UTF-8 become replacement characters."""
    shared = _shared_model(tokens.sparkSession, model)
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode_batches(shared), "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", spread=True))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents."""
    return encode(docs)

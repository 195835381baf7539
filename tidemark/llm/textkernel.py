"""Vectorised text primitives over Arrow string columns.

Everything works on the UTF-8 bytes of a whole slice of a column at once: word boundaries, word
hashes, hashes of word windows and of lines come from a few passes of numpy, with no Python
loop over rows or words. A word is a maximal run of ASCII letters or digits and of non-ASCII
characters, after lower-casing; nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call handles; a longer single text is handled whole.
SLICE_BYTES = 2 << 20
#: The word definition as a regular expression, for SQL over lower(text).
WORD_SQL = r"[^\x00-/:-`{-\x7f]+"

_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, np.ndarray] = {}

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 65536)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def _spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    inverse = pow(base, -1, 1 << 64)
    at = powers(inverse, int(start[-1]) + 1)[start] if len(start) else np.zeros(0, np.uint64)
    return mix((prefix[end] - prefix[start]) * at)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each row's begin and end."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at, n = np.cumsum(size), 0, len(size)
    while at < n:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of the texts of a column slice.

    start, end: byte positions; hash: 64-bit hashes; ptr: the words of row i are ptr[i]:ptr[i+1].
    """

    def __init__(self, col: pa.Array, lower: bool = True, data: tuple[np.ndarray, np.ndarray] | None = None):
        self.data, self.off = data or buffers(pc.utf8_lower(col) if lower else col)
        n = len(self.data)
        inside = IS_WORD[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = self.off[:-1][self.off[1:] > self.off[:-1]]
        before[full] = False
        after[self.off[1:][self.off[1:] > self.off[:-1]] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.ptr = np.searchsorted(self.start, self.off)
        self.hash = _spans(_prefix(_BYTES[self.data], _P), self.start, self.end, _P)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of `size` words within one row, and the word each starts at."""
        return windows(self.hash, self.ptr, size)


def windows(values: np.ndarray, ptr: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive values within one row, and the value each starts at."""
    n = np.maximum(np.diff(ptr) - size + 1, 0)
    at = ranges(ptr[:-1], n)
    return _spans(_prefix(values, _Q), at, at + size, _Q), at


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... count[i] of them, one run after another."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(start - shift, count)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, in the order of their starts."""
    return _spans(_prefix(_BYTES[data], _P), start, end, _P)


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words (already lower case), as Words gives them."""
    if not words:
        return np.zeros(0, np.uint64)
    data, off = buffers(pa.array(words, pa.string()))
    return span_hashes(data, off[:-1], off[1:])


class Lines:
    """Lines (split at "\\n") of the texts of a column slice; start and end are without white
    space at either end (spaces, tabs, carriage returns); raw_start and raw_end are with it."""

    def __init__(self, col: pa.Array):
        self.data, self.off = buffers(col)
        n = len(self.data)
        cut = np.flatnonzero(self.data == 10)
        row_of_cut = np.searchsorted(self.off, cut, "right") - 1
        rows = len(self.off) - 1
        count = np.bincount(row_of_cut, minlength=rows) + 1 if rows else np.zeros(0, np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        total = int(self.ptr[-1])
        self.raw_start, self.raw_end = np.empty(total, np.int64), np.empty(total, np.int64)
        first = np.zeros(total, bool)
        last = np.zeros(total, bool)
        if rows:
            first[self.ptr[:-1]] = True
            last[self.ptr[1:] - 1] = True
            self.raw_start[first] = self.off[:-1]
            self.raw_start[~first] = cut + 1
            self.raw_end[last] = self.off[1:]
            self.raw_end[~last] = cut
        solid = ~((self.data == 32) | (self.data == 9) | (self.data == 13) | (self.data == 10))
        at = np.flatnonzero(solid)
        lo = np.searchsorted(at, self.raw_start)
        hi = np.searchsorted(at, self.raw_end)
        self.blank = lo == hi
        pad = np.append(at, n)
        self.start = np.where(self.blank, self.raw_start, pad[lo])
        self.end = np.where(self.blank, self.raw_start, pad[np.maximum(hi - 1, 0)] + 1)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def words(self) -> np.ndarray:
        """How many words, parted by white space, each line has."""
        begins = ~((self.data == 32) | (self.data == 9) | (self.data == 13) | (self.data == 10))
        begins[1:] &= ~begins[:-1]
        begins[self.start[~self.blank]] = True
        return group_sums(begins, self.start, self.end)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def group_sums(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each span are set in mask."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[end] - total[start]


def mapper(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], text: str) -> Callable:
    """A mapInArrow function that applies fn to slices of bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return run

"""Static range asymmetric numeral system over many interleaved lanes.

A coder state x lives in [2^31, 2^63); frequencies sum to 2^SCALE_BITS. Lane i of a block codes
tokens i, i + LANES, i + 2 LANES, ...; all lanes take a step together, and the 32-bit words that
they put out share one stream: in each step those of the lanes that need one, in lane order.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE_BITS = 20
LANES = 512
SEGMENT_STEPS = 256  # steps between checkpoints
LOW = np.uint64(1 << 31)
_WORD, _MASK = np.uint64(32), np.uint64((1 << 32) - 1)


@dataclass
class Table:
    """Frequencies of all tokens, and where each begins; the same for every block."""

    freq: np.ndarray
    start: np.ndarray
    slot: np.ndarray  # the token of each of the 2^SCALE_BITS slots

    @classmethod
    def of(cls, freq: np.ndarray) -> Table:
        freq = freq.astype(np.uint64)
        if int(freq.sum()) != 1 << SCALE_BITS:
            raise ValueError("frequencies must sum to 2^SCALE_BITS")
        return cls(freq, np.cumsum(freq) - freq, np.repeat(np.arange(len(freq)), freq.astype(np.int64)).astype(np.int64))


def scale(counts: np.ndarray) -> np.ndarray:
    """Counts to frequencies that sum to 2^SCALE_BITS; each token keeps one at least, so tokens
    that were never counted can be coded too."""
    size = 1 << SCALE_BITS
    if len(counts) > size // 2:
        raise ValueError("too many tokens for the scale")
    total = max(int(counts.sum()), 1)
    room = size - len(counts)
    freq = 1 + np.floor(counts.astype(np.float64) / total * room).astype(np.int64)
    rest = size - int(freq.sum())
    order = np.argsort(-counts, kind="stable")
    if rest >= len(counts):
        freq += rest // len(counts)
        rest %= len(counts)
    freq[order[:rest]] += 1
    return freq


@dataclass
class Block:
    """An encoded block. A checkpoint for each segment: the lanes' states and the place in the
    stream from which its SEGMENT_STEPS steps decode, and the CRC-32 of its tokens."""

    tokens: int
    stream: bytes
    places: list[int]
    states: list[bytes]
    checksums: list[int]


def encode(tokens: np.ndarray, table: Table) -> Block:
    """Encode one block. Lanes code from their last step to the first, so that decoding runs
    forward; a checkpoint is kept where a segment begins."""
    n = len(tokens)
    steps = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    sizes, states = np.zeros(steps, np.int64), []
    freq, start = table.freq[tokens], table.start[tokens]
    limit = freq << np.uint64(63 - SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        to = slice(t * LANES, min((t + 1) * LANES, n))
        f, x = freq[to], state[: to.stop - to.start]
        full = x >= limit[to]
        words.append((x[full] & _MASK).astype(np.uint32))
        sizes[t] = len(words[-1])
        x = np.where(full, x >> _WORD, x)
        quotient = x // f
        state[: to.stop - to.start] = (quotient << np.uint64(SCALE_BITS)) + (x - quotient * f) + start[to]
        if t % SEGMENT_STEPS == 0:
            states.append(state.tobytes())
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    place = np.concatenate([[0], np.cumsum(sizes)])
    firsts = range(0, steps, SEGMENT_STEPS)
    size = SEGMENT_STEPS * LANES
    return Block(n, stream.tobytes(), [int(place[t]) for t in firsts], states[::-1], [zlib.crc32(tokens[i : i + size].astype("<u4").tobytes()) for i in range(0, n, size)])


def decode_segment(block: Block, table: Table, segment: int) -> np.ndarray:
    """Tokens of one segment, from its checkpoint alone; ValueError if they don't match its CRC."""
    first = segment * SEGMENT_STEPS * LANES
    n = min(SEGMENT_STEPS * LANES, block.tokens - first)
    state = np.frombuffer(block.states[segment], np.uint64).copy()
    stream = np.frombuffer(block.stream, np.uint32)
    at = block.places[segment]
    out = np.empty(n, np.int64)
    low = np.uint64((1 << SCALE_BITS) - 1)
    for t in range(-(-n // LANES)):
        to = slice(t * LANES, min((t + 1) * LANES, n))
        x = state[: to.stop - to.start]
        slot = x & low
        token = table.slot[slot.astype(np.int64)]
        out[to] = token
        x = table.freq[token] * (x >> np.uint64(SCALE_BITS)) + slot - table.start[token]
        empty = np.flatnonzero(x < LOW)
        if at + len(empty) > len(stream):
            raise ValueError("the stream ends too early")
        x[empty] = (x[empty] << _WORD) | stream[at : at + len(empty)].astype(np.uint64)
        at += len(empty)
        state[: to.stop - to.start] = x
    if zlib.crc32(out.astype("<u4").tobytes()) != block.checksums[segment]:
        raise ValueError(f"segment {segment} fails its checksum")
    return out

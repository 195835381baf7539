"""Winnowing: the positions that hold the least value of some window."""

from __future__ import annotations

import numpy as np

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """best over values[i : i + size] for each i that has so many values after it."""
    out, have = values, 1
    while have * 2 <= size:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = size - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def minima(values: np.ndarray, ptr: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `size` values within a row, the least value of each, and the chosen positions.

    Returns (start, least, chosen): each window's first position and least value, and a mask of
    the positions that hold the least value of at least one window (ties all count, so the choice
    depends on the window's content alone: equal windows choose equal values).
    """
    n = np.maximum(np.diff(ptr) - size + 1, 0)
    total = int(n.sum())
    shift = np.cumsum(n) - n
    start = np.arange(total, dtype=np.int64) + np.repeat(ptr[:-1] - shift, n)
    chosen = np.zeros(len(values), bool)
    if not total:
        return start, np.zeros(0, np.uint64), chosen
    least = _sliding(values, size, np.minimum)
    floor = np.zeros(len(values) + size - 1, np.uint64)  # windows across rows count as 0, the lowest
    floor[start + size - 1] = least[start]
    held = _sliding(floor, size, np.maximum)
    chosen = (held == values) & (held > 0)
    return start, least[start], chosen

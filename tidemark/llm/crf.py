"""A linear-chain conditional random field with two labels, over many chains at once."""

from __future__ import annotations

import numpy as np


def _walk(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chain starts from the longest chain to the shortest, and their lengths."""
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    return ptr[:-1][order], size[order]


def forward_backward(unary: np.ndarray, ptr: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal probability of label 1 at each place, expected label pairs (2 x 2, summed), and
    the summed log normaliser. unary: score of label 1 over label 0; chain i holds places
    ptr[i]:ptr[i+1]; pair[a, b]: score of b after a."""
    n = len(unary)
    emit = np.empty((n, 2))
    emit[:, 1] = 1 / (1 + np.exp(-np.clip(unary, -30, 30)))
    emit[:, 0] = 1 - emit[:, 1]
    base = np.logaddexp(0, np.clip(unary, -30, 30)).sum()
    step = np.exp(pair)
    start, size = _walk(ptr)
    longest = int(size[0]) if len(size) else 0
    alive = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]  # chains longer than t
    alpha, beta, scale = np.empty((n, 2)), np.ones((n, 2)), np.ones(n)
    for t in range(longest):
        at = start[: alive[t]] + t
        x = emit[at] * (alpha[at - 1] @ step if t else 1.0)
        scale[at] = x.sum(axis=1)
        alpha[at] = x / scale[at][:, None]
    expected = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = start[: alive[t]] + t
        ahead = emit[at] * beta[at]
        both = alpha[at - 1][:, :, None] * step[None] * ahead[:, None, :]
        expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = ahead @ step.T
        beta[at - 1] = back / back.sum(axis=1, keepdims=True)
    joint = alpha * beta
    return joint[:, 1] / joint.sum(axis=1), expected, float(base + np.log(scale).sum())


def fit(features: np.ndarray, ptr: np.ndarray, label: np.ndarray, ridge: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and pair scores by penalised maximum likelihood (Adam, full batches)."""
    weight, pair = np.zeros(features.shape[1]), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    inner = np.ones(len(label), bool)
    inner[ptr[:-1][np.diff(ptr) > 0]] = False
    at = np.flatnonzero(inner)
    np.add.at(seen, (label[at - 1], label[at]), 1)
    total = features.T @ label
    moment, spread = np.zeros(len(weight) + 4), np.zeros(len(weight) + 4)
    for k in range(1, rounds + 1):
        p, expected, _ = forward_backward(features @ weight, ptr, pair)
        grad = np.concatenate([features.T @ p - total + ridge * weight, (expected - seen + ridge * pair).ravel()]) / max(len(label), 1)
        moment, spread = 0.9 * moment + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        move = 0.1 * (moment / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 1e-8)
        weight, pair = weight - move[:-4], pair - move[-4:].reshape(2, 2)
    return weight, pair

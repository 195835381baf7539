"""Sequential weighted transducers: each arc reads a symbol, writes a symbol and has a cost;
composition feeds one machine's output to the next and adds the costs; compilation gives tables
that run over many strings at once."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Transducer:
    """start: its first state; step(state, symbol) -> (next state, output symbol, cost of the arc)."""

    start: Hashable
    step: Callable[[Hashable, str], tuple[Hashable, str, float]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes."""

        def step(state: tuple, symbol: str) -> tuple[tuple, str, float]:
            mine, middle, cost = self.step(state[0], symbol)
            theirs, out, more = other.step(state[1], middle)
            return (mine, theirs), out, cost + more

        return Transducer((self.start, other.start), step)


@dataclass(frozen=True)
class Compiled:
    """next_state[state, symbol], output[state, symbol] (an index into outputs) and cost[state, symbol]."""

    symbols: list[str]
    outputs: list[str]
    next_state: np.ndarray
    output: np.ndarray
    cost: np.ndarray


def compile_tables(machine: Transducer, symbols: list[str]) -> Compiled:
    """All states that can be reached, as tables."""
    states, queue, outputs, rows = {machine.start: 0}, [machine.start], {}, []
    for state in queue:
        row = []
        for symbol in symbols:
            to, out, cost = machine.step(state, symbol)
            if to not in states:
                states[to] = len(states)
                queue.append(to)
            row.append((states[to], outputs.setdefault(out, len(outputs)), cost))
        rows.append(row)
    table = np.array(rows, float)
    return Compiled(symbols, list(outputs), table[:, :, 0].astype(np.int64), table[:, :, 1].astype(np.int64), table[:, :, 2])


def run(machine: Compiled, symbol: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output and cost at each place; string i is symbol[ptr[i]:ptr[i+1]]. All strings advance together."""
    out, cost = np.zeros(len(symbol), np.int64), np.zeros(len(symbol))
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    start, size = ptr[:-1][order], size[order]
    state = np.zeros(len(start), np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, "left"))
        at = start[:n] + t
        x = symbol[at]
        out[at] = machine.output[state[:n], x]
        cost[at] = machine.cost[state[:n], x]
        state[:n] = machine.next_state[state[:n], x]
    return out, cost

"""Run-length grammars by recompression, and longest common extensions on them.

Blocks of equal symbols and pairs of different ones are compressed in turn, each
level a shorter sequence over new symbols, until no symbol occurs twice.  Equal
stretches are compressed alike but for a few symbols at their ends, so two
positions are compared by climbing while the symbols agree and descending where
they differ: a number of steps in the order of the levels, whatever the length of
the common stretch.  All queries of a batch take their steps together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from tailorspark.llm.textvec import mix64

_U = np.uint64


class _Level:
    """Nodes of one level: symbols, and the first child of each in the level below (null for the lowest)."""

    def __init__(self, symbols: np.ndarray, first_child: np.ndarray | None, blocks: bool):
        self.symbols, self.first_child, self.blocks = symbols, first_child, blocks


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for every pair of numbers, equal for equal pairs."""
    width = int(right.max()) + 1 if len(right) else 1
    return pd.factorize(left.astype(np.int64) * width + right)[0]


def _blocks(x: np.ndarray) -> _Level | None:
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    if len(start) == len(x):
        return None
    return _Level(_named(x[start], np.diff(np.append(start, len(x)))), start, True)


def _pairs(x: np.ndarray, salt: int) -> _Level | None:
    """Symbols are dealt to two sides; a symbol of the first followed by one of the second becomes one."""
    first = (mix64(x.astype(_U) + _U(salt << 40)) & _U(1)).astype(bool)
    pair = np.flatnonzero(first[:-1] & ~first[1:])
    if not len(pair):
        return None
    keep = np.ones(len(x), bool)
    keep[pair + 1] = False
    start = np.flatnonzero(keep)
    second = np.zeros(len(x), np.int64)  # 0: the node has one child
    second[pair] = x[pair + 1] + 1
    return _Level(_named(x[start], second[start]), start, False)


def _levels(symbols: np.ndarray) -> list[_Level]:
    out = [_Level(pd.factorize(symbols)[0], None, False)]
    salt = 0
    while True:
        x = out[-1].symbols
        if int(x.max()) + 1 == len(x):
            return out
        for make in (lambda: _blocks(out[-1].symbols), lambda: _pairs(out[-1].symbols, salt)):
            level = make()
            if level is not None:
                out.append(level)
        salt += 1


class Grammar:
    """Grammar of a sequence whose first and last symbols occur nowhere else."""

    def __init__(self, symbols: np.ndarray):
        levels = _levels(np.asarray(symbols))
        sizes = [len(v.symbols) for v in levels]
        base = np.cumsum([0, *sizes])
        n = int(base[-1])
        self.length = sizes[0]
        self._symbol = np.concatenate([v.symbols for v in levels])
        self._parent = np.full(n, -1, np.int64)
        self._ends = (np.zeros(n, bool), np.zeros(n, bool))  # is the first, the last child of its parent
        self._child = (np.full(n, -1, np.int64), np.full(n, -1, np.int64))  # its first, its last child
        self._left = (np.ones(n, np.int64), np.ones(n, np.int64))  # nodes of its block to its end, to its start
        for k in range(1, len(levels)):
            start, lo, hi = levels[k].first_child, int(base[k - 1]), int(base[k])
            stop = np.append(start[1:], sizes[k - 1])
            self._child[0][hi:hi + sizes[k]] = lo + start
            self._child[1][hi:hi + sizes[k]] = lo + stop - 1
            self._ends[0][lo + start] = True
            self._ends[1][lo + stop - 1] = True
            width = stop - start
            self._parent[lo:hi] = hi + np.repeat(np.arange(sizes[k]), width)
            if levels[k].blocks:
                at = np.arange(sizes[k - 1])
                self._left[0][lo:hi] = np.repeat(stop, width) - at
                self._left[1][lo:hi] = at - np.repeat(start, width) + 1

    def _extend(self, x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
        """How many symbols agree from positions x and y on, to the right (way 0) or to the left (1)."""
        symbol, parent, edge, child, left = self._symbol, self._parent, self._ends[way], self._child[way], self._left[way]
        sign = 1 - 2 * way
        out = np.zeros(len(x), np.int64)
        at = np.arange(len(x))
        begin, x, y = x, x.astype(np.int64), y.astype(np.int64)
        while len(at):
            same = symbol[x] == symbol[y]
            done = ~same & (x < self.length)
            if done.any():
                out[at[done]] = sign * (x[done] - begin[at[done]])
                go = ~done
                at, x, y, same = at[go], x[go], y[go], same[go]
            px, py = parent[x], parent[y]
            up = same & edge[x] & edge[y] & (px >= 0)
            up &= symbol[px] == symbol[py]
            step = sign * np.minimum(left[x], left[y])
            x, y = (np.where(up, p, np.where(same, z + step, child[z])) for p, z in ((px, x), (py, y)))
        return out

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of what starts at ``x`` and at ``y`` (different positions)."""
        return self._extend(x, y, 0)

    def left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common ending of what ends at ``x`` and at ``y``, both included."""
        return self._extend(x, y, 1)

"""Run-length grammars by recompression, and common extensions read from them (Jez, 2015; I, 2017).

A sequence is compressed in rounds. Block compression replaces each maximal
run of one symbol by a symbol for (symbol, length); pair compression splits
the symbols in two sides and replaces each pair of a left symbol and the right
symbol after it. Whether two neighbours are joined depends on them alone, so
equal stretches get equal symbols up to a few at their ends, in every round.
Common extensions climb over equal symbols of ever higher rounds and come down
again where these differ.

Many sequences are compressed as one, each closed by a symbol that occurs
nowhere else, which no extension can pass.
"""

from __future__ import annotations

import numpy as np

from .words import mix


def _first_of_runs(symbols: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))


class Grammar:
    """All rounds of the compression, one after the other in flat arrays.

    `rules` lists what each new symbol stands for: (symbol, length) of a
    block, (left, right) of a pair; `first_rule` is the number of the first.
    """

    def __init__(self, symbols: np.ndarray):
        """`symbols` must begin and end with a symbol that occurs nowhere else."""
        now, size = symbols.astype(np.int64), np.ones(len(symbols), np.int64)
        self.first_rule = fresh = int(now.max()) + 1
        self.rules: list[np.ndarray] = []
        levels, base, round_, idle = [], 0, 0, 0
        while True:
            levels.append((base, now, size))
            nxt = None
            while nxt is None and idle < 8:
                first, named, made = self._blocks(now, fresh) if round_ % 2 == 0 else self._pairs(now, fresh, round_)
                round_ += 1
                if len(first) < len(now):
                    nxt, idle = (first, named), 0
                    self.rules.append(made)
                    fresh += len(made)
                else:
                    idle += 1
            if nxt is None:
                break
            levels[-1] += (nxt[0],)
            size = np.add.reduceat(size, nxt[0])
            base, now = base + len(now), nxt[1]
        self._lay_out(levels)

    @staticmethod
    def _blocks(now: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = _first_of_runs(now)
        count = np.diff(np.append(first, len(now)))
        named, many = now[first], np.flatnonzero(count > 1)
        if not len(many):
            return first, named, np.zeros((0, 2), np.int64)
        order = np.lexsort((count[many], named[many]))
        pair = np.stack([named[many], count[many]], 1)[order]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)])
        named[many[order]] = fresh + np.cumsum(new) - 1
        return first, named, pair[new]

    @staticmethod
    def _pairs(now: np.ndarray, fresh: int, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = (mix(now.astype(np.uint64) * np.uint64(2) + np.uint64(round_ * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1)).astype(bool)
        at = max((np.flatnonzero(side[:-1] & ~side[1:]), np.flatnonzero(~side[:-1] & side[1:])), key=len)
        keep = np.ones(len(now), bool)
        keep[at + 1] = False
        first, named = np.flatnonzero(keep), now.copy()
        order = np.lexsort((now[at + 1], now[at]))
        pair = np.stack([now[at], now[at + 1]], 1)[order]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)])[: len(pair)]
        named[at[order]] = fresh + np.cumsum(new) - 1
        return first, named[first], pair[new]

    def _lay_out(self, levels: list[tuple]) -> None:
        total = sum(len(level[1]) for level in levels)
        self.symbol = np.concatenate([level[1] for level in levels])
        self.size = np.concatenate([level[2] for level in levels])
        self.up = np.full(total, -1)
        self.heads = np.zeros(total, bool)  # first child of its parent
        self.tails = np.zeros(total, bool)
        self.low = np.full(total, -1)  # first child
        self.high = np.full(total, -1)  # last child
        self.ahead = np.empty(total, np.int64)  # symbols from here to the end of their run
        self.behind = np.empty(total, np.int64)
        for base, now, _, *first in levels:
            begins = _first_of_runs(now)
            count = np.diff(np.append(begins, len(now)))
            place = np.arange(len(now)) - np.repeat(begins, count)
            self.behind[base : base + len(now)] = place + 1
            self.ahead[base : base + len(now)] = np.repeat(count, count) - place
            if first:
                above, end = base + len(now), np.append(first[0][1:], len(now)) - 1
                self.up[base:above] = above + np.repeat(np.arange(len(end)), end - first[0] + 1)
                self.heads[base + first[0]] = True
                self.tails[base + end] = True
                self.low[above : above + len(end)] = base + first[0]
                self.high[above : above + len(end)] = base + end

    def extensions(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """For each pair of places (never equal): how many symbols from there on agree, to the left if `back`."""
        edge, child, run = (self.tails, self.high, self.behind) if back else (self.heads, self.low, self.ahead)
        step = -1 if back else 1
        total = np.zeros(len(a), np.int64)
        row, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        falls = np.zeros(len(a), bool)
        while len(row):
            climbs = ~falls & edge[a] & edge[b]
            same = ~climbs & (self.symbol[a] == self.symbol[b])
            part = np.minimum(run[a], run[b])
            total[row[same]] += (part * self.size[a])[same]
            drops = ~climbs & ~same
            falls |= drops
            down = child[a]
            a = np.where(climbs, self.up[a], np.where(same, a + step * part, down))
            b = np.where(climbs, self.up[b], np.where(same, b + step * part, child[b]))
            on = ~drops | (down >= 0)
            if not on.all():
                row, a, b, falls = row[on], a[on], b[on], falls[on]
        return total

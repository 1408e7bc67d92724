"""Recompression of symbol sequences, and longest common extensions on its grammar.

Rounds of block compression (a maximal run of one symbol becomes a symbol) and pair
compression (a left symbol followed by a right one becomes a symbol) build a run-length
grammar, level by level. Whether two neighbours are joined depends on these two symbols
alone, so that equal stretches are parsed alike but for their ends. Two positions are
therefore compared by climbing: at every level at most one block or symbol is consumed
before both stand at the start of a node again; the first difference is then found by going
down, again with at most one block or symbol per level. All queries move together, as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

#: A round of pair compression draws coins until one pair in so many is joined, at most so often.
PAIRS_JOINED, DRAWS = 6, 16


@dataclass
class Level:
    """``symbols`` of one level. ``up`` leads to the nodes of the next level and ``first`` from
    those to their first symbols here (one more entry than nodes); None on the top level."""

    symbols: np.ndarray
    up: np.ndarray | None = None
    first: np.ndarray | None = None
    blocks: bool = False

    def mirrored(self) -> Level:
        if self.up is None:
            return Level(self.symbols[::-1])
        return Level(
            self.symbols[::-1], (len(self.first) - 2 - self.up)[::-1], (len(self.symbols) - self.first)[::-1], self.blocks
        )


def _coin(symbols: np.ndarray, turn: int) -> np.ndarray:
    """Whether a symbol is a left one: a bit of its hash, another in every round."""
    x = symbols.astype(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(40)) & np.uint64(1) == 1


def recompress(symbols: np.ndarray) -> list[Level]:
    """The levels of the grammar of ``symbols``. Negative symbols are boundaries, each of
    which stands once: they are never compressed."""
    levels = [Level(symbols.astype(np.int64))]
    fresh = int(symbols.max(initial=0)) + 1

    def climb(first: np.ndarray, joined: np.ndarray, keys: np.ndarray, blocks: bool) -> None:
        """Put a level on top whose nodes begin at ``first``; those ``joined`` are new
        symbols, the same for the same key."""
        nonlocal fresh
        below = levels[-1]
        above = below.symbols[first]
        codes, found = pd.factorize(keys)
        above[joined] = fresh + codes
        fresh += len(found)
        begins = np.zeros(len(below.symbols), np.int32)
        begins[first[1:]] = 1
        below.up = np.cumsum(begins, dtype=np.int32)
        below.first = np.append(first, len(below.symbols)).astype(np.int32)
        below.blocks = blocks
        levels.append(Level(above))

    def pairs_of(s: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Where a left symbol stands before a right one, by the best of some coins."""
        nonlocal turn
        best = inner[:0]
        for _ in range(DRAWS):
            left = _coin(s, turn)
            turn += 1
            differ = inner[left[inner] != left[inner + 1]]
            heads = left[differ]
            at = differ[heads] if 2 * heads.sum() >= len(differ) else differ[~heads]
            best = max(best, at, key=len)
            if PAIRS_JOINED * len(best) >= len(inner):
                break
        return best

    turn = 0
    while True:
        s = levels[-1].symbols
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        if len(first) < len(s):
            width = np.diff(np.append(first, len(s)))
            joined = np.flatnonzero(width > 1)
            climb(first, joined, (s[first[joined]] << 32) | width[joined], True)
            s = levels[-1].symbols
        inner = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
        at = pairs_of(s, inner)
        if not len(at):
            return levels
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        first = np.flatnonzero(keep)
        climb(first, np.searchsorted(first, at), (s[at] << 32) | s[at + 1], False)


def mirrored(levels: list[Level]) -> list[Level]:
    """The same grammar read from right to left: position p becomes length - 1 - p."""
    return [level.mirrored() for level in levels]


def common_extensions(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from ``a`` and from ``b`` on are equal, for each pair of different
    positions. A boundary is equal to nothing, so that no stretch goes past one."""
    start = a
    stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    query = np.arange(len(a))
    for level in levels:
        s = level.symbols
        equal = s[a] == s[b]
        done = ~equal
        if level.up is None:
            while len(at := np.flatnonzero(~done)):
                a[at], b[at] = a[at] + 1, b[at] + 1
                done[at] = s[a[at]] != s[b[at]]
            stopped.append((query, a, b))
            break
        up, first = level.up, level.first
        pa, pb = up[a], up[b]
        inside = equal & ((first[pa] != a) | (first[pb] != b))
        step = np.where(inside, np.minimum(first[pa + 1] - a, first[pb + 1] - b), 0) if level.blocks else inside.astype(np.int64)
        a, b = a + step, b + step
        pa, pb = up[a], up[b]
        done |= (first[pa] != a) | (first[pb] != b)
        stopped.append((query[done], a[done], b[done]))
        go = ~done
        query, a, b = query[go], pa[go].astype(np.int64), pb[go].astype(np.int64)
        if not len(query):
            break
    query, a, b = stopped.pop()
    for level in reversed(levels[: len(stopped)]):
        first, s = level.first, level.symbols
        ca, cb = first[a].astype(np.int64), first[b].astype(np.int64)
        equal = s[ca] == s[cb]
        step = np.where(equal, np.minimum(first[a + 1] - ca, first[b + 1] - cb), 0) if level.blocks else equal.astype(np.int64)
        more = stopped.pop()
        query, a, b = np.append(query, more[0]), np.append(ca + step, more[1]), np.append(cb + step, more[2])
    out = np.zeros(len(start), np.int64)
    out[query] = a
    return out - start

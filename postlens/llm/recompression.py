"""Longest common extensions over the run-length grammar that recompression builds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAX_LEVELS = 128


@dataclass(frozen=True)
class Level:
    """One string of the grammar.

    ``run_end`` is the first index after the run of equal symbols, ``parent`` the index of the
    symbol above that covers a symbol, ``first`` marks the first symbol below its parent.
    ``child`` is the index of a symbol's first symbol one level down.
    """

    symbol: np.ndarray
    run_end: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    child: np.ndarray


def _run_starts(symbol: np.ndarray) -> np.ndarray:
    change = np.ones(len(symbol), bool)
    change[1:] = symbol[1:] != symbol[:-1]
    return change


def _renamed(*keys: np.ndarray) -> np.ndarray:
    """Names 0, 1, ... of equal tuples of keys (non-negative)."""
    name = keys[0]
    for key in keys[1:]:
        name = name * (int(key.max(initial=0)) + 1) + key
        name = np.unique(name, return_inverse=True)[1]
    return name


def _pair_sides(symbol: np.ndarray, salt: int) -> np.ndarray:
    """True for symbols that may be the left of a pair: a hashed half, by the better way round."""
    mixed = (symbol.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    left = (mixed >> np.uint64(40)) & np.uint64(1) == 1
    forward = np.count_nonzero(left[:-1] & ~left[1:])
    return left if 2 * forward >= np.count_nonzero(left[:-1] != left[1:]) else ~left


def _merged(symbol: np.ndarray, pairs: bool, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the symbols of the next level begin, and their names.

    Block compression makes each maximal run one symbol, pair compression each
    (left, right) neighbours; all other symbols stay and keep a name of their own.
    """
    if not pairs:
        begins = np.flatnonzero(_run_starts(symbol))
        size = np.diff(np.append(begins, len(symbol)))
        return begins, _renamed(symbol[begins], size)
    left = _pair_sides(symbol, salt)
    paired = np.zeros(len(symbol), bool)
    paired[:-1] = left[:-1] & ~left[1:]
    second = np.zeros(len(symbol), bool)
    second[1:] = paired[:-1]
    begins = np.flatnonzero(~second)
    follower = np.append(symbol[1:], 0)[begins] + 1
    return begins, _renamed(symbol[begins], np.where(paired[begins], follower, 0))


class Grammar:
    """The levels of a recompressed text and extension queries for many positions at once.

    Levels alternate block and pair compression. A name of a level stands for one string
    and one only, so equal names extend a match by all they derive. Texts to be kept
    apart are separated by symbols that occur once.
    """

    def __init__(self, levels: list[Level], length: int) -> None:
        self.levels = levels
        self.length = length

    @classmethod
    def build(cls, text: np.ndarray) -> Grammar:
        """Recompress until nothing repeats any more; ``text`` holds names from 0."""
        n = len(text)
        symbol = text.astype(np.int64)
        child = np.arange(n)
        levels = []
        for k in range(MAX_LEVELS):
            begins, names = _merged(symbol, pairs=k % 2 == 1, salt=k)
            first = np.zeros(len(symbol), bool)
            first[begins] = True
            runs = np.flatnonzero(_run_starts(symbol))
            ends = np.append(runs[1:], len(symbol))
            run_end = np.repeat(ends, ends - runs)
            levels.append(Level(symbol, run_end, np.cumsum(first) - 1, first, child))
            # nothing above can serve two positions once every symbol occurs once
            if len(symbol) < 2 or len(np.unique(symbol)) == len(symbol):
                break
            symbol, child = names, begins
        return cls(levels, n)

    def mirrored(self) -> Grammar:
        """The grammar of the text read backwards."""
        levels = []
        for k, level in enumerate(self.levels):
            size = len(level.symbol)
            above = len(self.levels[k + 1].symbol) if k + 1 < len(self.levels) else 0
            last = np.ones(size, bool)
            last[:-1] = level.first[1:]
            runs = np.flatnonzero(_run_starts(level.symbol))
            run_start = np.repeat(runs, np.diff(np.append(runs, size)))
            below = len(self.levels[k - 1].symbol) if k else size
            last_child = np.append(level.child[1:], below) - 1
            levels.append(
                Level(
                    level.symbol[::-1],
                    (size - run_start)[::-1],
                    (above - 1 - level.parent)[::-1],
                    last[::-1],
                    (below - 1 - last_child)[::-1],
                )
            )
        return Grammar(levels, self.length)

    def extension(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the texts from ``one`` and from ``two``.

        Both positions climb while they stand at the first symbols of equal parents, else
        pass equal symbols, runs at once; at a difference they go down a level
        each time until single words differ. ``one`` and ``two`` may be the text's end.
        """
        a, b = one.astype(np.int64), two.astype(np.int64)
        up = np.arange(len(a))
        down_from = np.zeros(len(a), np.int64)
        for k, level in enumerate(self.levels):
            if not len(up):
                break
            top = k + 1 == len(self.levels)
            up = self._climb(level, None if top else self.levels[k + 1], a, b, up, down_from, k)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            here = np.flatnonzero(down_from >= k)
            self._pass(level, a, b, here)
            if k:
                below = self.levels[k - 1]
                a[here] = self._child(level, below, a[here])
                b[here] = self._child(level, below, b[here])
        return a - one

    @staticmethod
    def _child(level: Level, below: Level, at: np.ndarray) -> np.ndarray:
        size = len(level.symbol)
        return np.where(at < size, level.child[np.minimum(at, size - 1)], len(below.symbol))

    @staticmethod
    def _climb(level, above, a, b, up, down_from, k) -> np.ndarray:
        """Advance ``up`` on one level; those that reach the next level are returned."""
        size = len(level.symbol)
        risen = []
        while len(up):
            x, y = a[up], b[up]
            inside = (x < size) & (y < size)
            up, x, y = up[inside], x[inside], y[inside]
            if above is not None:
                p, q = level.parent[x], level.parent[y]
                rise = level.first[x] & level.first[y] & (above.symbol[p] == above.symbol[q])
                a[up[rise]], b[up[rise]] = p[rise], q[rise]
                down_from[up[rise]] = k + 1
                risen.append(up[rise])
                up, x, y = up[~rise], x[~rise], y[~rise]
            same = level.symbol[x] == level.symbol[y]
            up, x, y = up[same], x[same], y[same]
            step = np.minimum(level.run_end[x] - x, level.run_end[y] - y)
            a[up], b[up] = x + step, y + step
        return np.concatenate(risen) if risen else up

    @staticmethod
    def _pass(level, a, b, here) -> None:
        """Pass equal symbols of one level."""
        size = len(level.symbol)
        while len(here):
            x, y = a[here], b[here]
            inside = (x < size) & (y < size)
            here, x, y = here[inside], x[inside], y[inside]
            same = level.symbol[x] == level.symbol[y]
            here, x, y = here[same], x[same], y[same]
            step = np.minimum(level.run_end[x] - x, level.run_end[y] - y)
            a[here], b[here] = x + step, y + step

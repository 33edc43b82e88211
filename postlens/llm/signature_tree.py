"""Signature trees over sets of token hashes, and the pairs that their dual traversal leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 4
BYTES_AT_ONCE = 16 << 20


def width_of(n: int, bits_per_token: int = 4) -> int:
    """Bits of the bitmap of ``n`` tokens: a power of two, so that bitmaps of neighbours fold."""
    return max(64, 1 << int(n * bits_per_token - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    bits = np.zeros(width_of(len(tokens)), np.uint8)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Tree:
    """Nodes by level, from single sets to one root.

    A node holds the OR of the bitmaps below it, the range of set sizes, and the largest number
    of tokens that share a bit with another token of their set.
    """

    def __init__(self, members: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.members = members[order]
        sizes, bits = sizes[order], bits[order]
        extra = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, extra)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, at),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(extra, at),
                )
            )

    def folded(self) -> Tree:
        """The same tree with bitmaps of half the width."""
        out = object.__new__(Tree)
        out.members, half = self.members, self.levels[0][0].shape[1] // 2
        out.levels = []
        for bits, low, high, _ in self.levels:
            bits = bits[:, :half] | bits[:, half:]
            if not out.levels:
                extra = low - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            else:
                below = out.levels[-1][3]
                extra = np.maximum.reduceat(below, np.arange(0, len(below), FANOUT))
            out.levels.append((bits, low, high, extra))
        return out


def dual_traversal(x: Tree, y: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of ``x`` and ``y`` whose sets can have ``den * common >= num * union``.

    A pair of nodes is left when no sizes in their ranges fit together, or when the bits they
    share cannot hold the overlap that their smallest sets need. With ``x is y`` each pair
    comes once.
    """
    height = max(len(x.levels), len(y.levels)) - 1
    at_once = max(16, BYTES_AT_ONCE // x.levels[0][0][0].nbytes)
    stack = [(height, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > at_once:
            for at in range(0, len(i), at_once):
                part = slice(at, at + at_once)
                stack.append((level, i[part], j[part]))
            continue
        x_bits, x_low, x_high, x_extra = x.levels[min(level, len(x.levels) - 1)]
        y_bits, y_low, y_high, y_extra = y.levels[min(level, len(y.levels) - 1)]
        fits = (den * x_high[i] >= num * y_low[j]) & (den * y_high[j] >= num * x_low[i])
        i, j = i[fits], j[fits]
        shared = np.bitwise_count(x_bits[i] & y_bits[j]).sum(axis=1, dtype=np.int64)
        most = shared + np.minimum(x_extra[i], y_extra[j])
        fits = (num + den) * most >= num * (x_low[i] + y_low[j])
        i, j = i[fits], j[fits]
        if level == 0:
            if x is y:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield x.members[i], y.members[j]
            continue
        i, j = _children(x, level, i, j)
        j, i = _children(y, level, j, i)
        if x is y:
            i, j = i[i <= j], j[i <= j]
        if len(i):
            stack.append((level - 1, i, j))


def _children(tree: Tree, level: int, node: np.ndarray, other: np.ndarray):
    if level >= len(tree.levels):
        return node, other
    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    other = np.repeat(other, FANOUT)
    there = node < len(tree.levels[level - 1][0])
    return node[there], other[there]


def candidate_pairs(sizes: list[int], bitmaps: list[bytes], num: int, den: int):
    """Pairs of positions that a self-join of the sets cannot rule out."""
    by_width: dict[int, list[int]] = {}
    for at, bits in enumerate(bitmaps):
        by_width.setdefault(len(bits), []).append(at)
    trees = {}
    for width, members in by_width.items():
        words = np.frombuffer(b"".join(bitmaps[m] for m in members), np.uint64)
        trees[width] = Tree(
            np.array(members),
            np.array([sizes[m] for m in members], np.int64),
            words.reshape(len(members), width // 8),
        )
    for width, tree in trees.items():
        yield from dual_traversal(tree, tree, num, den)
        if 2 * width in trees:
            yield from dual_traversal(tree, trees[2 * width].folded(), num, den)


class Union:
    """Sets of positions that links have joined."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)

"""K-squared quadtree (k = 2) over a sparse count matrix, and the joint descent of two of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class QuadTree:
    """Non-zero cells of a matrix of side ``2 ** depth``.

    ``bits[l]`` has four flags for every node of level ``l`` (upper left, upper
    right, lower left, lower right quadrant: 1 where it has a non-zero cell); a
    set flag's rank is its child's number on the next level. The numbers of the
    last level are places in ``values``.
    """

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, depth: int):
        code = np.zeros(len(rows), np.int64)
        for bit in range(depth):
            code |= ((cols >> bit) & 1) << (2 * bit) | ((rows >> bit) & 1) << (2 * bit + 1)
        order = np.argsort(code)
        self.values, self.depth, self.empty = values[order], depth, not len(rows)
        self.bits, self.rank = [], []
        level = [code[order]]
        for _ in range(depth):
            level.append(np.unique(level[-1] >> 2))
        level.reverse()                                          # level[l]: Morton codes of the nodes of level l
        for l in range(depth):
            flags = np.zeros(4 * len(level[l]), bool)
            child = level[l + 1]
            flags[4 * np.searchsorted(level[l], child >> 2) + (child & 3)] = True
            self.bits.append(flags)
            self.rank.append(np.cumsum(flags) - 1)

    def below(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Number of the child in a quadrant; -1 below an empty node and for an empty quadrant."""
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits[level][at], self.rank[level][at], -1) if len(self.bits[level]) else node


def joint(a: QuadTree, b: QuadTree, rows: tuple[int, int], width: int, same: bool
          ) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, ...]]]:
    """Descend both trees over every pair of a row of ``a`` and a row of ``b``.

    Returns ``(zero, leaves)``: for each pair of rows the number of columns that
    lie in quadrants empty in both, and the remaining cells ``(row, row, column,
    value, value)``. With ``same`` the trees are one and only pairs with the
    smaller row first count.
    """
    depth, (m, n) = a.depth, rows
    step = np.zeros((m + 1, n + 1), np.int64)                    # two-way differences of ``zero``
    x = np.array([-1 if a.empty else 0])
    y = np.array([-1 if b.empty else 0])
    r = s = c = np.zeros(1, np.int64)
    if a.empty and b.empty:
        x = y = r = s = c = np.zeros(0, np.int64)
        step[0, 0] = width
    for level in range(depth):
        size = 1 << (depth - level - 1)
        i, j, k = (np.tile(np.array(v), len(x)) for v in np.unravel_index(np.arange(8), (2, 2, 2)))
        x, y, r, s, c = (np.repeat(v, 8) for v in (x, y, r, s, c))
        r, s, c = 2 * r + i, 2 * s + j, 2 * c + k
        held = (r * size < m) & (s * size < n) & (c * size < width)
        if same:
            held &= r <= s
        x, y, r, s, c, i, j, k = (v[held] for v in (x, y, r, s, c, i, j, k))
        x, y = a.below(level, x, 2 * i + k), b.below(level, y, 2 * j + k)
        none = (x < 0) & (y < 0)
        top, left = r[none] * size, s[none] * size
        down, right = np.minimum(top + size, m), np.minimum(left + size, n)
        many = np.minimum((c[none] + 1) * size, width) - c[none] * size
        for p, q, sign in ((top, left, 1), (down, left, -1), (top, right, -1), (down, right, 1)):
            np.add.at(step, (p, q), sign * many)
        x, y, r, s, c = (v[~none] for v in (x, y, r, s, c))
    if same:
        x, y, r, s, c = (v[r < s] for v in (x, y, r, s, c))
    value = lambda t, v: np.where(v >= 0, t.values[np.maximum(v, 0)], 0) if len(t.values) else np.zeros(len(v), np.int64)
    return step.cumsum(axis=0).cumsum(axis=1)[:m, :n], (r, s, c, value(a, x), value(b, y))

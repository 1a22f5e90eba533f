"""Vantage-point trees inside Spark tasks: build over one shard, search by blocks of queries.

The nearness is the inner product. With ``M`` the largest norm of the shard, the
point ``x`` becomes ``(x, sqrt(M^2 - |x|^2))`` and a query ``(q, 0)``: then
``|x' - q'|^2 = |q|^2 + M^2 - 2 q.x``, so that the nearest points are those of
largest inner product and the triangle inequality holds.

A node keeps its vantage point first; its other points, in order of distance from
it, are cut into two halves of equal size (equal points, too, are dealt out
evenly), each known by its least and largest distance.
"""

from __future__ import annotations

import numpy as np

LEAF = 256
TRIED = 8                    # vantage points tried at a node: the one whose distances vary most is taken
NO_ID = np.iinfo(np.int64).max


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, terms added from the first to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k].astype(np.float64) * b[:, k]
    return out


def _lifted(x: np.ndarray) -> tuple[np.ndarray, float]:
    norm = np.einsum("ij,ij->i", x, x)
    top = float(norm.max(initial=0.0))
    return np.column_stack([x, np.sqrt(np.maximum(top - norm, 0.0))]), float(np.sqrt(top))


def _distances(y: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((y - v) ** 2).sum(axis=1), 0.0))


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, bounds)``: the points in tree order, and for each inner node in
    preorder the least and largest distance of its two halves."""
    y, _ = _lifted(x.astype(np.float64))
    order, bounds = np.arange(len(x)), []
    rng = np.random.default_rng(len(x))
    todo = [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            continue
        here = order[a:b]
        some = y[here[rng.integers(0, len(here), LEAF)]]
        tried = rng.integers(0, len(here), TRIED)
        spread = [np.var(_distances(some, y[here[t]])) for t in tried]
        pick = int(tried[int(np.argmax(spread))])
        here[0], here[pick] = here[pick], here[0]
        far = _distances(y[here[1:]], y[here[0]])
        by = np.argsort(far, kind="stable")
        order[a + 1:b] = here[1:][by]
        far, half = far[by], (b - a - 1) // 2
        bounds.append((far[0], far[half - 1], far[half], far[-1]))
        todo += [(a + 1 + half, b), (a + 1, a + 1 + half)]
    return order, np.array(bounds).reshape(-1, 4)


class Tree:
    """Points in tree order; ``search`` gives each query's ``k`` of largest inner product."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, bounds: np.ndarray):
        self.x, self.ids, self.bounds = points, ids, bounds
        wide = points.astype(np.float64)
        norm = np.einsum("ij,ij->i", wide, wide)
        self.top = float(norm.max(initial=0.0))
        self.wide = wide
        self.visited = 0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, one row a query, best first; places that no point fills score ``-inf``.

        A half is left out when its least possible distance, times ``factor``, is
        more than the distance of the k-th best so far; with ``factor`` 1 the
        search is exact. Points with the query's own id take no part.
        """
        q = queries.astype(np.float64)
        norm = np.einsum("ij,ij->i", q, q)
        self.q, self.own, self.k, self.factor = q, own, k, factor
        self.base = norm + self.top
        self.slack = 1e-7 * np.sqrt(self.base)               # rounding of distances
        self.eps = 1e-12 * self.base
        self.best = np.full((len(q), k), -np.inf)
        self.got = np.full((len(q), k), NO_ID)
        if len(self.x) and len(q):
            self._visit(0, len(self.x), 0, np.arange(len(q)))
        return self.best, self.got

    def _nodes(self, n: int) -> int:
        """Inner nodes of a tree over ``n`` points."""
        if n <= LEAF:
            return 0
        half = (n - 1) // 2
        return 1 + self._nodes(half) + self._nodes(n - 1 - half)

    def _offer(self, a: int, b: int, near: np.ndarray, who: np.ndarray) -> None:
        """Points a:b, whose inner products are ``near`` up to rounding, to queries ``who``."""
        self.visited += near.size
        hopeful = near >= (self.best[who, -1] - self.eps[who])[:, None]
        hopeful &= self.ids[a:b][None, :] != self.own[who][:, None]
        count = hopeful.sum(axis=1)
        row = np.flatnonzero(count)
        if not len(row):
            return
        i, j = np.nonzero(hopeful[row])                      # i ascending
        count, most = count[row], int(count.max())
        place = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + self.k
        who = who[row]
        score = np.full((len(row), self.k + most), -np.inf)
        ids = np.full((len(row), self.k + most), NO_ID)
        score[:, :self.k], ids[:, :self.k] = self.best[who], self.got[who]
        score[i, place] = dots(self.x[a + j], self.q[who[i]])
        ids[i, place] = self.ids[a + j]
        first = np.lexsort((ids, -score), axis=1)[:, :self.k]
        self.best[who] = np.take_along_axis(score, first, 1)
        self.got[who] = np.take_along_axis(ids, first, 1)

    def _visit(self, a: int, b: int, node: int, who: np.ndarray) -> None:
        if b - a <= LEAF:
            self._offer(a, b, self.q[who] @ self.wide[a:b].T, who)
            return
        near = self.q[who] @ self.wide[a]
        self._offer(a, a + 1, near[:, None], who)
        d = np.sqrt(np.maximum(self.base[who] - 2 * near, 0.0))
        lo1, hi1, lo2, hi2 = self.bounds[node]
        half = (b - a - 1) // 2
        inner, outer = np.maximum(d - hi1, lo1 - d), np.maximum(lo2 - d, d - hi2)
        halves = ((a + 1, a + 1 + half, node + 1, inner), (a + 1 + half, b, node + 1 + self._nodes(half), outer))
        first = inner <= outer
        for some, order in ((first, halves), (~first, halves[::-1])):
            for s, e, child, least in order:
                ask = np.flatnonzero(some)
                kth = np.sqrt(np.maximum(self.base[who[ask]] - 2 * self.best[who[ask], -1], 0.0))
                ask = ask[(least[ask] - self.slack[who[ask]]) * self.factor <= kth]
                if len(ask):
                    self._visit(s, e, child, who[ask])

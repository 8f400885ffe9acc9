"""A multiway hyperplane tree with distance ranges between siblings (GNAT), as numpy arrays that tasks carry.

A node has up to ``fanout`` split points; a vector belongs to the child of its nearest one. For each split point and
each child the node stores the least and largest distance of the child's vectors to the point, and for each child
the least and largest squared norm. Split points come from a bounded sample; the ranges cover every indexed vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Relative room for rounding, so no subtree goes that holds an answer.
SLACK = 1e-7


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to those of ``b``."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Tree:
    """Children are numbered by node: a number of 0 or more is a node, a negative one is leaf ``-1 - number``."""

    def __init__(self, sample: np.ndarray, fanout: int, depth: int, seed: int = 7) -> None:
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(sample, fanout, depth, np.random.default_rng(seed))
        empty = [(len(c), len(p)) for c, p in zip(self.children, self.points, strict=True)]
        self.low = [np.full(s, np.inf) for s in empty]
        self.high = [np.full(s, -np.inf) for s in empty]
        self.norms = [np.tile([np.inf, -np.inf], (s[0], 1)) for s in empty]

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, sample: np.ndarray, fanout: int, depth: int, rng: np.random.Generator) -> int:
        points = self._spread(sample, fanout, rng) if depth and len(sample) > 1 else sample[:0]
        if len(points) < 2:
            return self._leaf()
        node = len(self.points)
        self.points.append(points)
        self.children.append([])
        near = distances(sample, points).argmin(1)
        self.children[node] = [self._grow(sample[near == k], fanout, depth - 1, rng) for k in range(len(points))]
        return node

    @staticmethod
    def _spread(sample: np.ndarray, fanout: int, rng: np.random.Generator) -> np.ndarray:
        """Of three times as many random vectors, one after another that lies farthest from those chosen."""
        some = sample[rng.permutation(len(sample))[: 3 * fanout]]
        chosen, away = [0], distances(some, some[:1])[:, 0]
        while len(chosen) < fanout and (best := int(away.argmax())) not in chosen and away[best] > 0:
            chosen.append(best)
            away = np.minimum(away, distances(some, some[best : best + 1])[:, 0])
        return some[chosen]

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector; the ranges on its way are widened to hold it."""
        leaf = np.zeros(len(vectors), np.int64)
        norm = (vectors * vectors).sum(1)
        open_ = [(self.root, np.arange(len(vectors)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                leaf[rows] = -1 - node
                continue
            away = distances(vectors[rows], self.points[node])
            near = away.argmin(1)
            for k in np.unique(near):
                mine = near == k
                self.low[node][k] = np.minimum(self.low[node][k], away[mine].min(0))
                self.high[node][k] = np.maximum(self.high[node][k], away[mine].max(0))
                n = norm[rows[mine]]
                self.norms[node][k] = min(self.norms[node][k, 0], n.min()), max(self.norms[node][k, 1], n.max())
                open_.append((self.children[node][k], rows[mine]))
        return leaf

    def ranges(self) -> Iterator[tuple[int, int, int, float, float]]:
        """(node, child, point or -1 for norms, least, largest) of the children that hold vectors."""
        for node, norms in enumerate(self.norms):
            for k in np.flatnonzero(np.isfinite(norms[:, 0])).tolist():
                yield node, k, -1, *norms[k].tolist()
                for i, (a, b) in enumerate(zip(self.low[node][k].tolist(), self.high[node][k].tolist(), strict=True)):
                    yield node, k, i, a, b

    def widen(self, ranges: Iterable[tuple[int, int, int, float, float]]) -> None:
        for node, k, i, a, b in ranges:
            if i < 0:
                self.norms[node][k] = min(self.norms[node][k, 0], a), max(self.norms[node][k, 1], b)
            else:
                self.low[node][k, i] = min(self.low[node][k, i], a)
                self.high[node][k, i] = max(self.high[node][k, i], b)

    def search(self, queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> dict[int, np.ndarray]:
        """leaf -> the queries for which it may hold a vector whose inner product with the query is within
        [least, most].

        A child's vectors of squared norms n0 to n1 then lie in the annulus between sqrt(q + n0 - 2 most) and
        sqrt(q + n1 - 2 least) around a query of squared norm q; the child goes if for any split point its range of
        distances can't meet that annulus.
        """
        norm = (queries * queries).sum(1)
        found: dict[int, np.ndarray] = {}
        open_ = [(self.root, np.arange(len(queries)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                found[-1 - node] = rows
                continue
            away = distances(queries[rows], self.points[node])
            for k, child in enumerate(self.children[node]):
                n0, n1 = self.norms[node][k]
                if not n0 <= n1:
                    continue
                inner = np.sqrt(np.maximum(norm[rows] + n0 - 2 * most[rows], 0))[:, None]
                outer = np.sqrt(np.maximum(norm[rows] + n1 - 2 * least[rows], 0))[:, None]
                room = SLACK * (1 + away + np.where(np.isfinite(outer), outer, 0))
                low, high = self.low[node][k], self.high[node][k]
                gone = (np.maximum(low - away, away - high) > outer + room) | (away + high < inner - room)
                gone = gone.any(1) | (norm[rows] + n1 - 2 * least[rows] < -room[:, 0] * (1 + away[:, 0]))
                if not gone.all():
                    open_.append((child, rows[~gone]))
        return found

"""Burkhard-Keller trees over 64-bit fingerprints, held as arrays.

A node's children are keyed by their Hamming distance to it, so a search
within radius r of a value at distance d from a node follows only the edges
d-r .. d+r.  Many trees (one per shard) are built and searched together.
"""

from __future__ import annotations

import numpy as np

_KEYS = 65
#: Queries of each tree in the first round of :meth:`Forest.connect`.
ROUND = 512
#: (query, node) pairs that a search holds at once.
FRONTIER = 1 << 20


class Forest:
    """One tree per value of ``tree``; the values of one tree must differ."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        self.values = values
        order = np.argsort(tree, kind="stable")
        firsts = np.flatnonzero(np.diff(tree[order], prepend=tree[order][:1] - 1)) if len(order) else order
        roots = order[firsts]
        sizes = np.diff(np.append(firsts, len(order)))
        self.root = np.empty(len(values), np.int64)
        self.root[order] = np.repeat(roots, sizes)
        #: A point's place among those of its tree.
        self.place = np.empty(len(values), np.int64)
        self.place[order] = np.arange(len(order)) - np.repeat(firsts, sizes)
        rest = np.setdiff1d(np.arange(len(values)), roots, assume_unique=True)
        parent = self.root[rest]
        keys, children, self.levels = [], [], []
        while len(rest):
            edge = parent * _KEYS + np.bitwise_count(values[rest] ^ values[parent])
            order = np.argsort(edge, kind="stable")
            rest, edge = rest[order], edge[order]
            new = np.diff(edge, prepend=-1) > 0
            keys.append(edge[new])
            children.append(rest[new])
            self.levels.append((edge[new] // _KEYS, rest[new]))
            child = rest[new][np.cumsum(new) - 1]
            rest, parent = rest[~new], child[~new]
        edges = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(edges)
        self.edges = edges[order]
        self.children = (np.concatenate(children) if children else np.zeros(0, np.int64))[order]

    def connect(self, radius: int, accept=None) -> np.ndarray:
        """For each point the smallest index among those that links within the radius reach.

        Queries go in rounds that double.  Between rounds, subtrees whose points
        all have one label are marked, and a query with that label doesn't enter
        them: nothing new is there.  So a dense group of points, which is one
        class after the first round, isn't compared pair by pair.

        With ``accept``, a pair within the radius links only if ``accept(a, b)``; pairs
        of one class aren't asked for, and the first round has one query of each tree.
        """
        label = np.arange(len(self.values))
        start, width = 0, 1 if accept else ROUND
        while len(query := np.flatnonzero((self.place >= start) & (self.place < start + width))):
            known = self._uniform(label) if start else None
            for a, b in self.search(radius, query, known):
                if accept is None:
                    merge(label, a, b)
                else:
                    _merge_accepted(label, a, b, accept)
            start, width = start + width, 2 * width
        return label

    def _uniform(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels, and of each subtree its label if it has one only, else -1."""
        low, high = label.copy(), label.copy()
        for parents, children in reversed(self.levels):
            np.minimum.at(low, parents, low[children])
            np.maximum.at(high, parents, high[children])
        return label.copy(), np.where(low == high, low, -1)

    def search(self, radius: int, query: np.ndarray | None = None, known: tuple[np.ndarray, np.ndarray] | None = None):
        """Yields arrays (query, node) of pairs within the radius, every pair from the side that comes first in its tree, in bounded pieces."""
        query = np.arange(len(self.values)) if query is None else query
        todo = [(query, self.root[query])]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            if known is not None:
                worth = known[0][query] != known[1][node]
                query, node = query[worth], node[worth]
            far = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            hit = (far <= radius) & (self.place[query] < self.place[node])
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.edges, node * _KEYS + np.maximum(far - radius, 0))
            high = np.searchsorted(self.edges, node * _KEYS + np.minimum(far + radius, _KEYS - 1), side="right")
            width = high - low
            total = int(width.sum())
            if total:
                at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(total)
                todo.append((np.repeat(query, width), self.children[at]))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the classes of linked items in place; each item ends at its class's smallest index so far."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low = np.minimum(x, y)
        np.minimum.at(label, np.maximum(x, y), low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


#: Pairs between which classes are brought up to date.
_BLOCK = 1024


def _merge_accepted(label: np.ndarray, a: np.ndarray, b: np.ndarray, accept) -> None:
    """Merges the classes of those pairs that differ in class and are accepted."""
    for start in range(0, len(a), _BLOCK):
        x, y = a[start : start + _BLOCK], b[start : start + _BLOCK]
        differ = label[x] != label[y]
        x, y = x[differ], y[differ]
        joined: dict[int, int] = {}

        def root(i: int) -> int:
            i = int(label[i])
            while i in joined:
                i = joined[i]
            return i

        some = []
        for i, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            one, other = root(p), root(q)
            if one != other and accept(p, q):
                joined[max(one, other)] = min(one, other)
                some.append(i)
        merge(label, x[some], y[some])

"""Cover trees over integer points, flat, for assigning whole subtrees.

Points are ordered by farthest-first traversal: the k-th point is the one
farthest from all before it, and that distance, its reach, never grows.  The
points of reach above ``R / 2**l`` are level ``l`` of a cover tree: they are
apart by more than that radius and every other point is within it of one of
them.  A point's parent is the nearest point of the level before its own.

Nodes are kept in the order of a walk through the tree, so a subtree is a range
of points and its count and sum are differences of two running sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: squared distances up to here are exact in doubles
EXACT = 1 << 53


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows of ``a`` and of ``b``, exact."""
    top = max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0)
    most = (2 * top) ** 2 * max(a.shape[1], 1)
    if most >= 1 << 63:
        raise ValueError("components beyond the range of 64-bit squared distances")
    kind = np.float64 if 2 * most < EXACT else np.int64
    a, b = a.astype(kind), b.astype(kind)
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return d.astype(np.int64)


@dataclass(frozen=True)
class CoverTree:
    """``points`` in walk order with ``counts`` of equal rows; per node the
    place of its centre, the range of its points, the squared distance of the
    farthest of them, and the range of its children in ``child``."""
    points: np.ndarray
    counts: np.ndarray
    centre: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    far: np.ndarray
    first_child: np.ndarray
    last_child: np.ndarray

    def running(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of all points before each place."""
        n = len(self.points)
        sums, counts = np.zeros((n + 1, self.points.shape[1]), np.int64), np.zeros(n + 1, np.int64)
        np.cumsum(self.points * self.counts[:, None], axis=0, out=sums[1:])
        np.cumsum(self.counts, out=counts[1:])
        return sums, counts

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest row of ``book`` for every range of points: (node, entry) of
        nodes assigned as a whole; ties go to the lower entry.

        A node goes as a whole if its centre's second nearest entry is farther
        than its nearest by more than twice the node's radius; else its
        children are looked at.  Single points are compared exactly."""
        nodes, entries = [], []
        at = np.zeros(min(len(self.centre), 1), np.int64)
        while len(at):
            d = squared(self.points[self.centre[at]], book)
            best = d.argmin(1)
            near = d[np.arange(len(at)), best]
            d[np.arange(len(at)), best] = np.iinfo(np.int64).max
            next_ = np.sqrt(d.min(1).astype(float)) if book.shape[0] > 1 else np.full(len(at), np.inf)
            gap = next_ - np.sqrt(near.astype(float))
            whole = (self.far[at] == 0) | (gap > 2 * np.sqrt(self.far[at].astype(float)) * (1 + 1e-9) + 1e-6)
            nodes.append(at[whole])
            entries.append(best[whole])
            at = at[~whole]
            size = self.last_child[at] - self.first_child[at]
            ahead = np.cumsum(size) - size
            at = np.repeat(self.first_child[at] - ahead, size) + np.arange(size.sum())
        return (np.concatenate(nodes), np.concatenate(entries)) if nodes else (at, at)

    def labels(self, book: np.ndarray) -> np.ndarray:
        """Nearest row of ``book`` for every point."""
        node, entry = self.assign(book)
        order = np.argsort(self.begin[node])
        node, entry = node[order], entry[order]
        return np.repeat(entry, self.end[node] - self.begin[node])


def _traversal(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first order from the first point, and squared reaches."""
    n = len(d)
    order, reach = np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = d[0].copy()
    for k in range(1, n):
        order[k] = far = int(least.argmax())
        reach[k] = least[far]
        np.minimum(least, d[far], out=least)
    return order, reach


def build(rows: np.ndarray) -> tuple[CoverTree, np.ndarray]:
    """Tree of integer ``rows``, and the place of each row in its points."""
    points, back, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    n = len(points)
    if not n:
        none = np.zeros(0, np.int64)
        return CoverTree(points.reshape(0, rows.shape[1]), none, none, none, none, none, none, none), none
    d = squared(points, points)
    order, reach = _traversal(d)
    level = np.zeros(n, np.int64)
    if n > 1:
        level[1:] = 1 + np.floor((np.log2(float(reach[1])) - np.log2(reach[1:].astype(float))) / 2).astype(np.int64)
        level = np.maximum.accumulate(level)
    # parent: the nearest point of an earlier level; points of one level are siblings or cousins
    parent = np.full(n, -1)
    for lv in range(1, int(level[-1]) + 1 if n > 1 else 0):
        a, b = np.searchsorted(level, [lv, lv + 1])
        if a < b:
            parent[a:b] = d[np.ix_(order[a:b], order[:a])].argmin(1)
    kids: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        kids[parent[k]].append(k)
    # nodes (point, place in its kids): a point's subtree, coarsest kids first, splits into itself with later
    # levels and the kids of its coarsest level
    place = np.zeros(n, np.int64)
    centre, first, last, walk = [], [], [], []
    # breadth first numbering, so that children of a node are neighbours
    spans = [(0, 0)]
    at = 0
    while at < len(spans):
        k, i = spans[at]
        first.append(len(spans))
        if i < len(kids[k]):
            lv = level[kids[k][i]]
            j = i
            while j < len(kids[k]) and level[kids[k][j]] == lv:
                j += 1
            spans.append((k, j))
            spans.extend((c, 0) for c in kids[k][i:j])
        last.append(len(spans))
        centre.append(k)
        at += 1
    # depth first over the numbered nodes gives the walk and the ranges
    begin, end = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64)
    todo = [(0, False)]
    while todo:
        node, done = todo.pop()
        if done:
            end[node] = len(walk)
            continue
        begin[node] = len(walk)
        todo.append((node, True))
        if first[node] == last[node]:
            place[spans[node][0]] = len(walk)
            walk.append(spans[node][0])
        else:
            todo.extend((c, False) for c in range(last[node] - 1, first[node] - 1, -1))
    walk_of = np.array(walk)
    where = np.zeros(n, np.int64)
    where[order] = place
    centre = np.array(centre)
    far = np.zeros(len(spans), np.int64)
    own = order[walk_of]
    for node in np.flatnonzero(end - begin > 1).tolist():
        far[node] = d[order[centre[node]], own[begin[node]:end[node]]].max()
    tree = CoverTree(points[own], counts[own], place[centre], begin, end, far, np.array(first), np.array(last))
    return tree, where[back.ravel()]

"""E8 lattice points of projected vectors, with numpy."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((-1, 1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


SHORTEST = _shortest()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (whole coordinates with an even sum)."""
    point = np.rint(x)
    off = x - point
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    w = worst[rows]
    point[rows, w] += np.where(off[rows, w] >= 0, 1, -1)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of every row (8 columns): D8 or D8 shifted by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def neighbours(x: np.ndarray, point: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` neighbouring points nearest to each row: (rows, count, 8)."""
    best = np.argsort(-((x - point) @ SHORTEST.T), axis=1, kind="stable")[:, :count]
    return point[:, None, :] + SHORTEST[best]


class Tables:
    """Hash tables of a dimension: each has ``blocks`` random projections to
    eight coordinates, decoded to E8; their points together are a cell."""

    def __init__(self, dim: int, tables: int, blocks: int, scale: float, probes: int, seed: int = 8):
        rng = np.random.default_rng([seed, dim])
        self.tables, self.blocks, self.probes = tables, blocks, probes
        # projected length of a unit difference: about ``scale`` at any dimension
        self.planes = rng.standard_normal((tables, blocks, dim, 8)) * (scale / np.sqrt(8))
        self.shift = rng.random((tables, blocks, 8))
        self.mix = rng.integers(1, 1 << 62, (blocks, 8), dtype=np.int64) | 1

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """(rows, 1 + blocks * probes): own cell, then neighbouring ones."""
        with np.errstate(over="ignore"):
            parts, near = [], []
            for b in range(self.blocks):
                x = self._projected(unit, table, b)
                point = decode(x)
                name = lambda p, b=b: ((2 * p).astype(np.int64) * self.mix[b]).sum(axis=-1)
                parts.append(name(point))
                near.append(name(neighbours(x, point, self.probes)))
            own = sum(parts)
            probed = [own[:, None] - parts[b][:, None] + near[b] for b in range(self.blocks)]
            return np.concatenate([own[:, None], *probed], axis=1)

    def _projected(self, unit: np.ndarray, table: int, block: int) -> np.ndarray:
        """Sums coordinate by coordinate, so that a vector's cell is the same
        whatever rows are computed with it."""
        x = np.repeat(self.shift[table, block][None], len(unit), axis=0)
        for d in range(unit.shape[1]):
            x += unit[:, d, None] * self.planes[table, block, d]
        return x

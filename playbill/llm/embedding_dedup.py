"""Embedding near-dedup by lattice hashing.

A vector is projected at random to eight coordinates and decoded to the
nearest point of the E8 lattice, in several tables.  It is filed under its own
cell and asks in the neighbouring cells nearest to it; pairs that meet are
verified by cosine.  All vectors are filed; recall is a matter of ``tables``
and ``probes`` and is measured in the tests.

Cells are cut into blocks of BLOCK vectors and compared block by block, so a
cell of any size is many small tasks.  A pair that meets several times counts
in the first table, and there in the smallest cell, where it meets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected, stored
from .lattice import Tables

BLOCK = 512
KEYS = ("dim", "tab", "cell", "i", "j")


@dataclass(frozen=True)
class Settings:
    tables: int = 8
    blocks: int = 1
    scale: float = 2.0
    probes: int = 2

    def of(self, dim: int) -> Tables:
        return Tables(dim, self.tables, self.blocks, self.scale, self.probes)


def units(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(vectors: DataFrame) -> DataFrame:
    """(node, vec_id, raw): vectors as bytes of doubles, null where they link
    with nothing: null, empty, zero, or with null or non-finite parts."""
    def work(col: pa.Array) -> pa.Array:
        out = []
        for v in col.to_pylist():
            ok = v and all(x is not None for x in v)
            x = np.array(v, np.float64) if ok else np.zeros(1)
            with np.errstate(over="ignore"):
                square = (x * x).sum()
            if not np.isfinite(square) and np.isfinite(x).all():
                x = x / np.abs(x).max()  # too long to square: only its direction counts
                square = (x * x).sum()
            elif 0 < square < 1e-200 or (square == 0 and x.any()):
                x = x / np.abs(x).max()
                square = (x * x).sum()
            out.append(x.tobytes() if np.isfinite(square) and square > 0 else None)
        return pa.array(out, pa.binary())

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.arrow_udf(work, "binary")("embedding").alias("raw"))
    return stored(rows.withColumn("node", F.monotonically_increasing_id()), "vectors")


def filed(rows: DataFrame, settings: Settings) -> DataFrame:
    """(dim, tab, cell, home, node, raw): one row per table and cell asked."""
    def work(batches):
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            sizes = np.array([len(r) // 8 for r in raw])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                unit = units([raw[k] for k in at], dim)
                hashing = settings.of(dim)
                for t in range(settings.tables):
                    cells = hashing.cells(unit, t)
                    width = cells.shape[1]
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array([dim] * cells.size, pa.int32()), "tab": pa.array([t] * cells.size, pa.int32()),
                        "cell": pa.array(cells.ravel(), pa.int64()),
                        "home": pa.array((np.arange(cells.size) % width == 0)),
                        "node": batch.column("node").take(pa.array(np.repeat(at, width)))})

    kind = "dim int, tab int, cell long, home boolean, node long"
    return rows.filter("raw is not null").select("node", "raw").mapInArrow(work, kind)


def met(key, home, node, unit, side, hashing: Tables, least: float):
    """Linked pairs of one pair of blocks that count here: rows (a, b)."""
    dim, tab, cell, i, j = key
    left = np.flatnonzero(side == i)
    right = np.flatnonzero(side == j)
    if not len(left) or not len(right):
        return np.zeros((0, 2), int)
    a, b = np.nonzero(unit[left] @ unit[right].T >= least)
    a, b = left[a], right[b]
    ok = home[a] | home[b]
    if i == j:
        ok &= a < b
    a, b = a[ok], b[ok]
    if not len(a):
        return np.zeros((0, 2), int)
    used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = back[:len(a)], back[len(a):]
    stay = np.ones(len(a), bool)
    for t in range(tab + 1):
        cells = hashing.cells(unit[used], t)
        own = cells[:, 0]
        there = (cells[v] == own[u][:, None]).any(axis=1)
        here = (cells[u] == own[v][:, None]).any(axis=1)
        if t < tab:
            stay &= ~(there | here)
        else:
            top = np.iinfo(np.int64).max
            stay &= np.minimum(np.where(there, own[u], top), np.where(here, own[v], top)) == cell
    return np.column_stack([a[stay], b[stay]])


def _labels(pairs: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each member's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(settings: Settings, least: float):
    """Over rows sorted by KEYS: (node, links, root) per pair of blocks."""
    def group(key, cols):
        node = np.concatenate([c["node"] for c in cols])
        home = np.concatenate([c["home"] for c in cols])
        side = np.concatenate([c["side"] for c in cols])
        unit = units([r for c in cols for r in c["raw"]], key[0])
        pairs = met(key, home, node, unit, side, settings.of(key[0]), least)
        if not len(pairs):
            return None
        links = np.bincount(pairs.ravel(), minlength=len(node))
        label = _labels(pairs, len(node))
        some = links > 0
        return node[some], links[some], node[label[some]]

    def work(batches):
        key, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*KEYS, "node", "home", "side")}
            raw = batch.column("raw").to_pylist()
            keys = np.column_stack([cols[k] for k in KEYS])
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            out = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=True):
                now = tuple(keys[s].tolist())
                if now != key and held:
                    out.append(group(key, held))
                    held = []
                key = now
                held.append({"node": cols["node"][s:e], "home": cols["home"][s:e], "side": cols["side"][s:e], "raw": raw[s:e]})
            yield _batch(out)
        if held:
            yield _batch([group(key, held)])

    return work


def _batch(found) -> pa.RecordBatch:
    found = [f for f in found if f is not None]
    cols = [np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "links", "root"])


def near_vectors(vectors: DataFrame, least: float = 0.95, settings: Settings | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their cosine is at least ``least``; ``component_id`` is
    the smallest vec_id reachable.  Vectors that are null, empty or zero, hold
    null or non-finite parts, or have no other of their length link with
    nothing.  Each row is a vector of its own, repeated rows too; a row without
    vec_id has the smallest one of its component, if there is any.  An empty
    table gives no rows; columns other than vec_id and embedding are not read.
    """
    settings = settings or Settings()
    rows = usable(vectors)
    asked = stored(filed(rows, settings), "cells")
    sizes = asked.groupBy("dim", "tab", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home"))
    sizes = stored(sizes.filter("n > 1 and any_home"), "cellsizes")
    many = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    blocks = asked.join(sizes, ["dim", "tab", "cell"]).withColumn("many", many) \
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    blocks = blocks.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).select(
        "dim", "tab", "cell", F.least("x", "side").alias("i"), F.greatest("x", "side").alias("j"), "side", "home", "node")
    blocks = blocks.join(rows.select("node", "raw"), "node")
    found = stored(blocks.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(
        compare(settings, least), "node long, links long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "components")
    out = rows.select("node", "vec_id").join(counts, "node", "left").join(roots, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    first = out.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    first = stored(first, "roots")
    return out.join(first, "root").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast(T.LongType())).alias("n_links"), "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

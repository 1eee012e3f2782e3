"""Substring dedup over words by level-wise doubling.

A window of 50 words can only repeat if the windows of 25 inside it do, and
those only if their windows of 13 do.  So 13-word windows are counted first,
windows of 25 only where these repeat, windows of 50 only where those do.

At the two lower levels one window of each 50 stands for it: the one with the
smallest hash.  Equal windows of 50 choose alike, so nothing is missed, and a
twentieth of all places is counted.  At the last level every surviving window
is compared by a 128-bit hash of its words; whole copies by a cryptographic one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, stored
from .grams import Words, digest, slices, window_minimum, windows

WINDOW = 50
#: stands for a null doc_id, which comes after all others
LAST = (1 << 63) - 1


def levels(window: int) -> list[int]:
    """Lengths below ``window``, each half of the next (rounded up)."""
    half = -(-window // 2)
    return [-(-half // 2), half]


def arrays(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    sizes = np.array([0, *map(len, parts)], np.int64)
    flat = np.concatenate([np.zeros(0, kind), *[np.asarray(a).view(kind) if a.dtype == np.uint64 else np.asarray(a, kind) for a in parts]])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat))


class Lines:
    """Word sequence of a slice, its windows and who stands for them."""

    def __init__(self, data, off, window):
        self.words = Words(data, off)
        self.upto, self.window = self.words.upto, window
        self.line = self.words.hashes()
        n = len(self.words.start)
        ends = np.repeat(self.upto[1:], np.diff(self.upto))
        #: starts of windows that stay inside their text
        self.starts = np.flatnonzero(np.arange(n) + window <= ends)
        self.row = self.words.row[self.starts] if n else np.zeros(0, int)

    def hashes(self, length: int) -> np.ndarray:
        return windows(self.line, length)

    def copies(self) -> np.ndarray:
        """Digest of the words of every row that has a window."""
        raw, off = self.words.data.tobytes(), self.words.off.tolist()
        out = np.zeros((len(off) - 1, 2), np.int64)
        for k in np.flatnonzero(np.diff(self.upto) >= self.window).tolist():
            out[k] = digest(b" ".join(raw[off[k]:off[k + 1]].split()))
        return out

    def chosen(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window: place and hash of its smallest part of ``length``."""
        h = self.hashes(length)
        place = window_minimum(h, self.window - length + 1)
        at = place[self.starts] if len(self.starts) else np.zeros(0, int)
        return at, h[at] if len(at) else np.zeros(0, np.uint64)


def _per_row(values, row, n):
    """Distinct values of each row."""
    cut = np.searchsorted(row, np.arange(n + 1))
    return [np.unique(values[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _within(values, row, n, allowed: list):
    """Which values are among those allowed for their row."""
    cut = np.searchsorted(row, np.arange(n + 1)).tolist()
    out = np.zeros(len(values), bool)
    for k in range(n):
        if cut[k] < cut[k + 1] and allowed[k]:
            out[cut[k]:cut[k + 1]] = np.isin(values[cut[k]:cut[k + 1]], np.array(allowed[k], np.int64).view(np.uint64))
    return out


def with_key(docs: DataFrame) -> DataFrame:
    """(id, tie, text): rows are told apart by doc_id and a hash of the text."""
    return docs.select(*row_key(docs), F.coalesce("text", F.lit("")).alias("text"))


def in_many(rows: DataFrame, column: str) -> DataFrame:
    """(id, tie, kept): of the hashes in ``column`` those that two ids hold."""
    each = rows.select("id", "tie", F.explode(column).alias("h"))
    many = each.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("h")
    many = stored(many, "many")  # on its own, so that a join on a hot window can be split
    return each.join(many, "h").groupBy("id", "tie").agg(F.collect_set("h").alias("kept"))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, tie, starts, copy) of rows that lose words: ``starts`` of windows
    that also start in a document with a smaller id; a ``copy`` of a whole
    smaller document loses all its words."""
    low, high = levels(window)

    def profile(texts: pa.Array) -> pa.Array:
        n_words, d1, d2, anchors = [], [], [], []
        for _, data, off in slices(texts):
            lines = Lines(data, off, window)
            n = len(off) - 1
            n_words.append(np.diff(lines.upto))
            whole = lines.copies()
            d1.append(whole[:, 0])
            d2.append(whole[:, 1])
            anchors += _per_row(lines.chosen(low)[1], lines.row, n)
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *[a.astype(np.int64) for a in x]])
        return pa.StructArray.from_arrays([pa.array(join(n_words)), pa.array(join(d1)), pa.array(join(d2)),
                                           arrays(anchors)], ["n", "d1", "d2", "anchors"])

    def second_level(texts: pa.Array, allowed: pa.Array) -> pa.Array:
        allowed, out = allowed.to_pylist(), []
        for at, data, off in slices(texts):
            lines = Lines(data, off, window)
            n = len(off) - 1
            ok = _within(lines.chosen(low)[1], lines.row, n, allowed[at:at + n])
            out += _per_row(lines.chosen(high)[1][ok], lines.row[ok], n)
        return arrays(out)

    def last_level(texts: pa.Array, allowed: pa.Array, allowed_2: pa.Array) -> pa.Array:
        allowed, allowed_2 = allowed.to_pylist(), allowed_2.to_pylist()
        starts, h1, h2 = [], [], []
        for at, data, off in slices(texts):
            lines = Lines(data, off, window)
            n = len(off) - 1
            ok = _within(lines.chosen(low)[1], lines.row, n, allowed[at:at + n]) \
                & _within(lines.chosen(high)[1], lines.row, n, allowed_2[at:at + n])
            s, row = lines.starts[ok], lines.row[ok]
            a, b = lines.hashes(window)[s], windows(lines.words.hashes(1), window, 1)[s]
            cut = np.searchsorted(row, np.arange(n + 1)).tolist()
            for k in range(n):
                part = slice(cut[k], cut[k + 1])
                starts.append(s[part] - lines.upto[k])
                h1.append(a[part])
                h2.append(b[part])
        return pa.StructArray.from_arrays([arrays(starts), arrays(h1), arrays(h2)], ["starts", "h1", "h2"])

    rows = with_key(docs)
    kind = "n long, d1 long, d2 long, anchors array<long>"
    found = stored(rows.select("id", "tie", F.arrow_udf(profile, kind)("text").alias("r")).select("id", "tie", "r.*"), "windows")
    # whole copies: the smallest id stands for all of them at every level
    whole = found.filter(F.col("n") >= window).groupBy("n", "d1", "d2").agg(
        F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    copies = stored(found.join(whole, ["n", "d1", "d2"]).filter("id > first").select("id", "tie").distinct(), "copies")
    first = found.filter(F.size("anchors") > 0).select("id", "tie", "anchors").join(copies, ["id", "tie"], "left_anti")
    one = stored(in_many(first, "anchors").withColumnRenamed("kept", "k1"), "level1")
    some = rows.join(one, ["id", "tie"])
    two = F.arrow_udf(second_level, "array<long>")("text", "k1")
    two = stored(some.select("id", "tie", two.alias("anchors")), "level2")
    two = stored(in_many(two, "anchors").withColumnRenamed("kept", "k2"), "level2")
    some = rows.join(one.join(two, ["id", "tie"]), ["id", "tie"])
    full = F.arrow_udf(last_level, "starts array<long>, h1 array<long>, h2 array<long>")("text", "k1", "k2")
    full = stored(some.select("id", "tie", full.alias("r")).select("id", "tie", "r.*"), "level3")
    each = full.select("id", "tie", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("w")).select("id", "tie", "w.*")
    least = each.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    lost = each.join(stored(least.drop("last"), "least"), ["h1", "h2"]).filter("id > first") \
        .groupBy("id", "tie").agg(F.collect_set("starts").alias("starts"))
    nothing = F.lit(None).cast("array<long>")
    return lost.withColumn("copy", F.lit(False)).unionByName(
        copies.withColumns({"starts": nothing, "copy": F.lit(True)}))


def removal(window: int):
    def work(texts: pa.Array, starts: pa.Array, copy: pa.Array) -> pa.Array:
        kept, counts, removed = [], [], []
        for text, first, whole in zip(texts.to_pylist(), starts.to_pylist(), copy.to_pylist(), strict=True):
            words = (text or "").encode().split()  # bytes: ASCII white space only
            counts.append(len(words))
            if whole:
                left = []
            elif first:
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.array(first)
                edge[at] += 1
                np.subtract.at(edge, at + window, 1)
                stay = np.cumsum(edge)[:-1] == 0
                left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            else:
                left = words
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                                          ["kept_text", "n_words", "n_removed"])
    return work


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("id"), \
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("tie")


def dedup_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with kept_text, n_words and n_removed.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Every word covered by a
    window of ``window`` words that also starts in a document with a smaller
    doc_id goes; windows are judged on the input.  What is left is joined by
    one space.  A null text has no words; a null doc_id comes after all
    others; repeated rows of one doc_id do not remove each other.  Texts of any
    length are read whole; an empty table gives no rows.  Columns with the
    names of results are replaced; others travel as one struct, so none
    clashes.
    """
    gone = repeats(docs.select("doc_id", "text"), window)
    base = docs.select(boxed(docs, "kept_text", "n_words", "n_removed"), *row_key(docs))
    out = F.arrow_udf(removal(window), "kept_text string, n_words long, n_removed long")("row.text", "starts", "copy")
    return base.join(gone, ["id", "tie"], "left").select("row", out.alias("new")).select("row.*", "new.*")

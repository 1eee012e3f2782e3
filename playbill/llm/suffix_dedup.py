"""Substring dedup over bytes with Burrows-Wheeler transforms.

Equal strings of ``least`` bytes must meet in one task.  Each such string has
an anchor: its 64-byte part with the smallest hash, leftmost on ties.  Equal
strings have equal anchors, so strings are dealt by anchor.  The strings of
one anchor at one place are a stretch; stretches are gathered thus:

1. whole copies are set aside: all their bytes go;
2. anchors with one occurrence fall away, and with them most of the text;
3. equal stretches are counted by digest before any text moves: two and more
   repeat as a whole;
4. a stretch that occurs once can still share part of its strings with others
   of its anchor.  Those, and one copy of every other stretch of the anchor,
   are dealt to tasks, which find shared prefixes of ``least`` bytes by
   interval expansion on the transform (``bwt``).

An anchor with more than MANY different stretches would make one task too
large.  Its strings are compared one by one instead, by a 128-bit hash that
combines before it is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeated_starts
from .common import boxed, stored
from .grams import byte_stretches, byte_windows, digests, slices, window_minimum
from .substring_dedup import arrays, row_key, with_key

LEAST = 400
ANCHOR = 64
#: bytes of stretches one transform takes; a larger anchor group is taken alone
TASK_BYTES = 1 << 21
#: different stretches of one anchor that go to one task
MANY = 20_000


class Runs:
    """Anchors of a slice: runs of starts of strings with one anchor."""

    def __init__(self, data, off, least, anchor=ANCHOR):
        self.least, n = least, len(data)
        self.data = data
        at = np.arange(max(n - anchor + 1, 0))
        grams = byte_stretches(data).hash(at, at + anchor)
        place = window_minimum(grams, least - anchor + 1)
        sizes = np.diff(off)
        fits = np.maximum(sizes - least + 1, 0)
        row = np.repeat(np.arange(len(sizes)), fits)
        start = np.repeat(off[:-1], fits) + np.arange(len(row)) - np.repeat(np.cumsum(fits) - fits, fits)
        here = place[start] if len(start) else np.zeros(0, int)
        new = np.append(True, (here[1:] != here[:-1]) | (row[1:] != row[:-1]))[:len(row)]
        head = np.flatnonzero(new)
        self.row, self.start = row[head], start[head]
        self.count = np.diff(np.append(head, len(row)))
        self.anchor = grams[here[head]] if len(head) else np.zeros(0, np.uint64)
        self.offset = here[head] - self.start
        self.begin = self.start - off[self.row] if len(head) else self.start

    def digests(self, some):
        """128-bit digest of stretches: their bytes and where the anchor is."""
        s, e = self.start[some], self.start[some] + self.count[some] + self.least - 1
        return digests(self.data, s, e, self.offset[some]).T


def _rows(n, row):
    cut = np.searchsorted(row, np.arange(n + 1)).tolist()
    return [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def profile(least: int):
    """Size, digest and anchors of a text; of an anchor that comes several
    times, two are told."""
    def work(texts: pa.Array) -> pa.Array:
        n, d1, d2, anchors = [], [], [], []
        for _, data, off in slices(texts):
            runs = Runs(data, off, least)
            n.append(np.diff(off))
            whole, long = np.zeros((len(off) - 1, 2), np.int64), np.flatnonzero(np.diff(off) >= least)
            whole[long] = digests(data, off[:-1][long], off[1:][long])
            d1.append(whole[:, 0])
            d2.append(whole[:, 1])
            for part in _rows(len(off) - 1, runs.row):
                found, times = np.unique(runs.anchor[part], return_counts=True)
                anchors.append(np.concatenate([found, found[times > 1]]))
        join = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())
        return pa.StructArray.from_arrays([join(n), join(d1), join(d2), arrays(anchors)], ["n", "d1", "d2", "anchors"])
    return work


def stretches(least: int):
    """Stretches of the allowed anchors: begin, count, anchor, digest."""
    def work(texts: pa.Array, allowed: pa.Array) -> pa.Array:
        allowed = allowed.to_pylist()
        cols = [[] for _ in range(5)]
        for at, data, off in slices(texts):
            runs = Runs(data, off, least)
            for k, part in enumerate(_rows(len(off) - 1, runs.row)):
                some = np.flatnonzero(np.isin(runs.anchor[part], np.array(allowed[at + k] or [], np.int64).view(np.uint64))) + part.start
                g1, g2 = runs.digests(some)
                for col, v in zip(cols, (runs.begin[some], runs.count[some], runs.anchor[some], g1, g2), strict=True):
                    col.append(v)
        return pa.StructArray.from_arrays([arrays(c) for c in cols], ["begin", "count", "anchor", "g1", "g2"])
    return work


def cut_out(least: int):
    """Bytes of the stretches asked for."""
    def work(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for text, places in zip(texts.to_pylist(), wanted.to_pylist(), strict=True):
            raw = (text or "").encode()
            out.append([raw[p["begin"]:p["begin"] + p["count"] + least - 1] for p in places])
        return pa.array(out, pa.list_(pa.binary()))
    return work


def single_strings(least: int):
    """Begin and 128-bit hash of every string of the stretches asked for."""
    def work(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        wanted = wanted.to_pylist()
        cols = [[] for _ in range(4)]
        for at, data, off in slices(texts):
            lanes = byte_windows(data, least, 0), byte_windows(data, least, 1)
            for k in range(len(off) - 1):
                places = wanted[at + k]
                begin = np.concatenate([np.zeros(0, np.int64), *[p["begin"] + np.arange(p["count"]) for p in places]])
                once = np.concatenate([np.zeros(0, np.int64), *[np.full(p["count"], p["once"], np.int64) for p in places]])
                s = begin + off[k]
                for col, v in zip(cols, (begin, once, *(x[s] for x in lanes)), strict=True):
                    col.append(v)
        return pa.StructArray.from_arrays([arrays(c) for c in cols], ["begin", "once", "h1", "h2"])
    return work


def expand(least: int, task_bytes: int = TASK_BYTES):
    """Over rows sorted by anchor: runs of repeated starts of stretches.
    Whole anchor groups are gathered up to ``task_bytes`` for a transform."""
    kind = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])

    def solved(rows):
        out = []
        for (_, once, i, t, begin, _), hits in zip(rows, repeated_starts([r[5] for r in rows], least), strict=True):
            if once and len(hits):
                edge = np.flatnonzero(np.diff(hits) > 1)
                for a, b in zip(hits[np.append(0, edge + 1)].tolist(), hits[np.append(edge, len(hits) - 1)].tolist(), strict=True):
                    out.append((i, t, begin + a, begin + b + least))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=kind)

    def work(batches):
        held, group, size, now = [], [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "once", "id", "tie", "begin", "raw")), strict=True):
                if row[0] != now:
                    held += group
                    group, now = [], row[0]
                    if size >= task_bytes and held:
                        yield solved(held)
                        held, size = [], 0
                group.append(row)
                size += len(row[5])
        if held or group:
            yield solved(held + group)
    return work


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, tie, spans, copy) of rows that lose bytes: spans {from, to} of
    strings that also start elsewhere; a ``copy`` loses all its bytes."""
    rows = with_key(docs)
    kind = "n long, d1 long, d2 long, anchors array<long>"
    found = rows.select("id", "tie", F.arrow_udf(profile(least), kind)("text").alias("r")).select("id", "tie", "r.*")
    found = stored(found, "bytes")
    whole = found.filter(F.col("n") >= least).groupBy("n", "d1", "d2").agg(
        F.min(F.struct("id", "tie")).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    copies = stored(found.join(whole.drop("rows"), ["n", "d1", "d2"]).select(
        "id", "tie", (F.struct("id", "tie") == F.col("first")).alias("stands")).distinct(), "copies")
    # one row stands for all its copies among the others
    others = copies.filter("not stands").select("id", "tie")
    pool = found.filter(F.size("anchors") > 0).select("id", "tie", "anchors").dropDuplicates(["id", "tie"]) \
        .join(others, ["id", "tie"], "left_anti")
    each = pool.select("id", "tie", F.explode("anchors").alias("anchor"))
    many = stored(each.groupBy("anchor").count().filter("count > 1").select("anchor"), "many")
    allowed = each.join(many, "anchor").groupBy("id", "tie").agg(F.collect_set("anchor").alias("allowed"))
    allowed = stored(allowed, "anchors")
    texts = rows.dropDuplicates(["id", "tie"]) if _repeated(found) else rows
    kind = ", ".join(f"{c} array<long>" for c in ("begin", "count", "anchor", "g1", "g2"))
    cut = F.arrow_udf(stretches(least), kind)("text", "allowed")
    cut = texts.join(allowed, ["id", "tie"]).select("id", "tie", cut.alias("r")).select("id", "tie", "r.*")
    cut = stored(cut, "stretches").select("id", "tie", F.explode(F.arrays_zip("begin", "count", "anchor", "g1", "g2")).alias("s")) \
        .select("id", "tie", "s.*")
    kinds = cut.groupBy("anchor", "g1", "g2").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "tie", "begin", "count")).alias("first"))
    kinds = stored(kinds, "kinds")
    equal = cut.join(kinds.filter("times > 1").select("anchor", "g1", "g2"), ["anchor", "g1", "g2"]).select(
        "id", "tie", F.col("begin").alias("from"), (F.col("begin") + F.col("count") + least - 1).alias("to"))
    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("times").alias("least"))
    groups = stored(groups.filter("n > 1 and least = 1").select("anchor", (F.col("n") > MANY).alias("large")), "groups")
    asked = stored(kinds.join(groups, "anchor").select("anchor", "large", (F.col("times") == 1).alias("once"), "first.*"), "asked")

    def of(large: bool):
        places = F.collect_list(F.struct("anchor", "once", "begin", "count")).alias("places")
        return texts.join(asked.filter(F.col("large") == large).groupBy("id", "tie").agg(places), ["id", "tie"])

    raw = F.arrow_udf(cut_out(least), "array<binary>")("text", "places")
    parts = of(False).select("id", "tie", "places", raw.alias("raw"))
    parts = parts.select("id", "tie", F.explode(F.arrays_zip("places", "raw")).alias("p")).select(
        "p.places.anchor", "p.places.once", "id", "tie", "p.places.begin", "p.raw")
    part = parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        expand(least), "id long, tie long, from long, to long")
    part = stored(part, "runs")
    if not groups.filter("large").isEmpty():
        kind = ", ".join(f"{c} array<long>" for c in ("begin", "once", "h1", "h2"))
        single = F.arrow_udf(single_strings(least), kind)("text", "places")
        single = stored(of(True).select("id", "tie", single.alias("r")).select("id", "tie", "r.*"), "strings")
        single = single.select("id", "tie", F.explode(F.arrays_zip("begin", "once", "h1", "h2")).alias("s")).select("id", "tie", "s.*")
        several = stored(single.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"), "several")
        part = part.unionByName(single.filter("once = 1").join(several, ["h1", "h2"]).select(
            "id", "tie", F.col("begin").alias("from"), (F.col("begin") + least).alias("to")))
    spans = equal.unionByName(part).groupBy("id", "tie").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    nothing = F.lit(None).cast("array<struct<from:bigint,to:bigint>>")
    spans = spans.join(copies.select("id", "tie").distinct(), ["id", "tie"], "left_anti")
    return spans.withColumn("copy", F.lit(False)).unionByName(
        copies.select("id", "tie").distinct().withColumns({"spans": nothing, "copy": F.lit(True)}))


def _repeated(found: DataFrame) -> bool:
    return not found.groupBy("id", "tie").count().filter("count > 1").isEmpty()


def _kept(texts: pa.Array, spans: pa.Array, copy: pa.Array) -> pa.Array:
    kept, sizes, removed, runs = [], [], [], []
    for text, gone, whole in zip(texts.to_pylist(), spans.to_pylist(), copy.to_pylist(), strict=True):
        raw = (text or "").encode()
        merged = [[0, len(raw)]] if whole else []
        for s in sorted((g["from"], g["to"]) for g in gone or ()):
            if merged and s[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s[1])
            else:
                merged.append(list(s))
        left, at = [], 0
        for a, b in merged:
            left.append(raw[at:a])
            at = b
        left.append(raw[at:])
        left = b"".join(left)
        kept.append(left)
        sizes.append(len(raw))
        removed.append(len(raw) - len(left))
        runs.append([{"from": a, "to": b} for a, b in merged])
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
         pa.array(runs, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))],
        ["kept_bytes", "n_bytes", "n_removed", "spans"])


def dedup_bytes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with kept_bytes, n_bytes, n_removed and spans {from, to}.

    Texts are UTF-8 bytes (null: none).  Every byte covered by a string of
    ``least`` bytes that also starts anywhere else, in this text or another,
    goes; strings are judged on the input and never cross texts.  Repeated
    rows are texts of their own, so each of them goes.  ``kept_bytes`` is
    binary: a cut may fall inside a character.  Texts of any length are read
    whole; a null doc_id is a value like others; an empty table gives no rows.
    Columns with the names of results are replaced; others travel as one
    struct, so none clashes.
    """
    if least < 2 * ANCHOR:
        raise ValueError(f"least must be at least {2 * ANCHOR}")
    gone = repeats(docs.select("doc_id", "text"), least)
    base = docs.select(boxed(docs, "kept_bytes", "n_bytes", "n_removed", "spans"), *row_key(docs))
    kind = "kept_bytes binary, n_bytes long, n_removed long, spans array<struct<from:bigint,to:bigint>>"
    out = F.arrow_udf(_kept, kind)("row.text", "spans", "copy")
    return base.join(gone, ["id", "tie"], "left").select("row", out.alias("new")).select("row.*", "new.*")

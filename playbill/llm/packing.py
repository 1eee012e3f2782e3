"""Best-fit packing in bulk-synchronous rounds.

Items and gaps (open sequences with free room) are range-sorted by size, which
gives each a rank within its size.  A round sweeps the sizes downwards: items
of a size go to the smallest gap that holds them, its successor, and from
there to the next larger one when it runs out.  Where several items want the
gaps of one size, ranks decide: the first items get the first gaps.  Then gaps
are updated and the next round begins, until every item has a place.

Only the counts per size (at most ``capacity`` of them) meet in one place.
Items and gaps stay distributed; a round is a broadcast of at most
``2 * capacity`` intervals and one join of items to gaps on (size, rank).
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

INTERVALS = ("length", "lo", "hi", "take", "free", "gap_lo")
MOVES = ("free", "gap_lo", "gap_hi", "to_lo", "left_free")


def local(spark, rows, names) -> DataFrame:
    """A broadcast table of at most ``2 * capacity`` rows."""
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return F.broadcast(spark.createDataFrame(pa.table(
        {n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)})))


def successor_sweep(items: dict[int, tuple[int, int]], gaps: dict[int, int]):
    """One sweep over counts.  ``items``: size -> (first waiting rank, count);
    ``gaps``: free room -> count.

    Returns (size, lo, hi, take, free, gap_lo): items of ``size`` with ranks
    lo..hi-1 go, ``take`` at a time, to the gaps of ``free`` from rank gap_lo.
    """
    left, used, frees, out = dict(gaps), dict.fromkeys(gaps, 0), sorted(gaps), []
    for size in sorted(items, reverse=True):
        lo, n = items[size]
        at = bisect_left(frees, size)
        while n and at < len(frees):
            free = frees[at]
            take = free // size
            m = min(n, left[free] * take)
            spent = -(-m // take)
            out.append((size, lo, lo + m, take, free, used[free]))
            used[free] += spent
            left[free] -= spent
            lo, n = lo + m, n - m
            if not left[free]:
                frees.pop(at)
    return out


def updated_gaps(matches, gaps: dict[int, int]):
    """Where each interval of gaps goes: its new room and first new rank.
    Rows as in MOVES; gaps that no item took are intervals too."""
    rows, at, taken = [], {}, dict.fromkeys(gaps, 0)

    def put(room, n):
        first = at.get(room, 0)
        at[room] = first + n
        return first

    for size, lo, hi, take, free, gap_lo in matches:
        full, rest = divmod(hi - lo, take)
        taken[free] = gap_lo + full + bool(rest)
        if full:
            room = free - take * size
            rows.append((free, gap_lo, gap_lo + full, put(room, full), room))
        if rest:
            room = free - rest * size
            rows.append((free, gap_lo + full, gap_lo + full + 1, put(room, 1), room))
    for free, n in gaps.items():
        if taken[free] < n:
            rows.append((free, taken[free], n, put(free, n - taken[free]), free))
    return rows, at


def pack(items: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    """``items`` (with long ``length``, 1..capacity) with sequence_id and offset.

    ``keys`` order items of equal length; equal rows may swap places.  Every
    item is placed whole, sequences hold at most ``capacity``, places are
    gapless from 0, and sequence ids are dense within each round.  Items of
    no length, or longer than ``capacity``, are refused.
    """
    spark = items.sparkSession
    ranked = numbered(items, F.desc("length"), *keys, tag="items", name="_rank")
    counts = sorted((r[0], r[1]) for r in ranked.groupBy("length").count().collect())
    if not counts:
        return items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    if counts[0][0] < 1 or counts[-1][0] > capacity:
        raise ValueError(f"lengths must be 1..{capacity}")
    start, seen = {}, 0
    for size, n in reversed(counts):
        start[size] = seen
        seen += n
    sizes = local(spark, [(s, start[s]) for s, _ in counts], ("length", "_start"))
    ranked = ranked.join(sizes, "length").withColumn("_rank", F.col("_rank") - F.col("_start")).drop("_start")

    # no two items above half the capacity share a sequence: each opens one
    half = capacity // 2
    large = F.col("length") > half
    opened = {s: start[s] for s, _ in counts if s > half}
    first = local(spark, list(opened.items()), ("length", "_base"))
    placed = [ranked.filter(large).join(first, "length").withColumns({
        "sequence_id": F.col("_base") + F.col("_rank"), "offset": F.lit(0).cast("long")}).drop("_base", "_rank")]
    gaps = placed[0].filter(F.col("length") < capacity).join(first, "length").select(
        (capacity - F.col("length")).alias("free"), (F.col("sequence_id") - F.col("_base")).alias("rank"), "sequence_id")
    room = {capacity - s: n for s, n in counts if half < s < capacity}
    next_id = sum(n for s, n in counts if s > half)
    waiting = {s: (0, n) for s, n in counts if s <= half}
    pending = ranked.filter(~large)

    while waiting:
        need = sum(s * n for s, (_, n) in waiting.items())
        have = sum(f * n for f, n in room.items())
        fresh = max(0, -(-(need - have) // capacity))
        if not fresh and max(room, default=0) < min(waiting):
            fresh = -(-need // capacity)
        if fresh:
            begin = room.get(capacity, 0)
            more = spark.range(fresh).select(
                F.lit(capacity).cast("long").alias("free"), (F.col("id") + begin).alias("rank"),
                (F.col("id") + next_id).alias("sequence_id"))
            gaps = gaps.unionByName(more)
            room[capacity] = begin + fresh
            next_id += fresh
        matches = successor_sweep(waiting, room)
        plan = local(spark, matches, INTERVALS)
        fit = pending.join(plan, (pending["length"] == plan["length"]) & (F.col("_rank") >= F.col("lo"))
                           & (F.col("_rank") < F.col("hi")), "left").drop(plan["length"])
        fit = fit.withColumns({"rank": F.expr("gap_lo + (_rank - lo) div take"),
                               "_slot": (F.col("_rank") - F.col("lo")) % F.col("take")}).drop("lo", "hi", "take", "gap_lo")
        done = fit.filter(F.col("free").isNotNull()).join(gaps, ["free", "rank"]).withColumn(
            "offset", capacity - F.col("free") + F.col("_slot") * F.col("length"))
        placed.append(stored(done.select(*placed[0].columns), "placed"))
        rows, room = updated_gaps(matches, room)
        used = {s: 0 for s in waiting}
        for size, lo, hi, *_ in matches:
            used[size] += hi - lo
        waiting = {s: (lo + used[s], n - used[s]) for s, (lo, n) in waiting.items() if n > used[s]}
        if not waiting:
            break
        pending = stored(fit.filter(F.col("free").isNull()).drop("free", "rank", "_slot"), "pending")
        # sequences that hold nothing that waits are closed
        least = min(waiting)
        room = {f: n for f, n in room.items() if f >= least}
        moves = local(spark, [r for r in rows if r[-1] >= least], MOVES)
        gaps = stored(gaps.join(moves, (gaps["free"] == moves["free"]) & (F.col("rank") >= F.col("gap_lo"))
                                & (F.col("rank") < F.col("gap_hi"))).select(
            F.col("left_free").alias("free"), (F.col("to_lo") + F.col("rank") - F.col("gap_lo")).alias("rank"),
            "sequence_id"), "gaps")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out

"""Ranking that survives a hot key.

A window partitioned by a key sends the whole key to one task, and a join all
rows of a key.  The helpers here cut the key first: top-k and joins by salting,
ordinals and carry-forward by ranges of the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playbill.session import BROADCAST_ROWS, cut_lineage

SALT = 32
#: keys a sketch of the most frequent ones reports, and those it keeps count of
HEAVY, TRACKED = 64, 10_000


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key.  An aggregate, not a window: each map task
    ships one row per key, however many copies it holds."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                k: int | None, rank: str = "rank", salt: int = SALT) -> DataFrame:
    """The first ``k`` rows of every key with their rank.

    Rows are ranked inside salted sub-keys first (Spark also limits every map
    task through ``WindowGroupLimit``), so the window over the key itself sees
    at most ``k * salt`` rows of a hot key.  The result equals the plain window.
    """
    if k is None:
        raise ValueError("a top-k report needs k")
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns
                                                        if not _unhashable(df, c)]),
                                           F.lit(salt)))
    near = Window.partitionBy(*keys, "_salt").orderBy(*order)
    far = Window.partitionBy(*keys).orderBy(*order)
    part = spread.withColumn(rank, F.row_number().over(near)).filter(F.col(rank) <= k)
    return part.drop("_salt").withColumn(rank, F.row_number().over(far)) \
        .filter(F.col(rank) <= k)


def _unhashable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` dealt into ranges of (keys, order) of about equal size, with
    ``_range``, the number of a row's range.  A hot key spans many ranges, and
    rows equal in keys and order share one."""
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def ordinal_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """1-based position inside every key: a segmented prefix sum.

    Rows are counted inside each (key, range), and shifted by what earlier
    ranges hold of the key.  Only one row per key and range is carried on.
    """
    cut = in_ranges(df, keys, order)
    near = Window.partitionBy(*keys, "_range").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = cut.withColumn("_near", F.row_number().over(near))
    return null_safe_join(ranked, sizes, [*keys, "_range"], "inner") \
        .withColumn(name, (F.col("_near") + F.col("_shift")).cast("long")) \
        .drop("_near", "_shift", "_range")


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  value: str, name: str) -> DataFrame:
    """Last non-null ``value`` at or before every row of its key.

    As ``ordinal_per_key``: inside a range a running ``last``; across ranges
    the last marker of every earlier range, one row per key and range.
    """
    cut = in_ranges(df, keys, order)
    near = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    tails = cut.groupBy(*keys, "_range").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
        .alias("_tail")) \
        .withColumn("_carried", F.last("_tail", ignorenulls=True).over(before)).drop("_tail")
    local = cut.withColumn("_near", F.last(F.col(value), ignorenulls=True).over(near))
    return null_safe_join(local, tails, [*keys, "_range"], "inner") \
        .withColumn(name, F.coalesce("_near", "_carried")) \
        .drop("_near", "_carried", "_range")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str) -> DataFrame:
    """Equi-join where null keys meet; the left side's keys are kept."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = same if cond is None else cond & same
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def heavy_keys(df: DataFrame, key: str, share: float = 0.005) -> list:
    """Keys that at least about ``share`` of the rows have, at most HEAVY.
    The sketch is a combinable aggregate of fixed size."""
    top, rows = df.filter(F.col(key).isNotNull()).agg(
        F.call_function("approx_top_k", F.col(key), F.lit(HEAVY), F.lit(TRACKED)), F.count(F.lit(1))).first()
    return [x["item"] for x in top or [] if x["count"] >= share * rows]


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str,
                max_rows: int = BROADCAST_ROWS, salt: int = SALT) -> DataFrame:
    """Join on a key that may be hot or null on the left.

    A right side that a bounded count proves small is broadcast.  Otherwise a
    sketch finds the heavy keys; their rows, and rows without a key, are
    dealt over ``salt`` tasks, and the right side's rows of heavy keys go to
    each.  ``how`` is inner or left."""
    right = cut_lineage(right)  # counted and joined, but computed once
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), key, how)
    heavy = heavy_keys(left, key)
    hot = F.col(key).isin(heavy) if heavy else F.lit(False)
    dealt = left.withColumn("_salt", F.when(F.col(key).isNull() | hot, F.floor(F.rand(7) * salt).cast("int")).otherwise(0))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"], how).drop("_salt")

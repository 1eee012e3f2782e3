"""Merging a batch of observations into the staged table.

Parquet tables take no MERGE, so the merge is a full outer join on the id
whose result is the next version.  Both sides are unique per id, so no key is
hot; ``collapse_batch`` makes the incoming side so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.operators.identity import content_hash, stable_id
from playbill.schema import EVENT_FIELDS, EVENT_SCHEMA, REFILL_FIELDS, STAGED_SCHEMA, is_blank


def collapse_batch(batch: DataFrame, order: Column,
                   keys: Sequence[str] = ("source", "source_url")) -> DataFrame:
    """One row per key out of several observations in a batch, as if they had
    been merged one after the other: the last value of every field, the last
    filled value of a detail field, and a latched sold-out flag.  All parts
    are combinable aggregates, so copies collapse before the shuffle.
    Observations of one moment are ordered by a hash of their fields, so the
    result does not depend on the order of arrival."""
    fields = [f for f in batch.columns if f not in keys]
    order = F.struct(order.alias("at"), F.xxhash64(*fields).alias("tie"))
    aggs = []
    for f in fields:
        if f == "is_sold_out":
            aggs.append(F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f))
        elif f in REFILL_FIELDS:
            filled = F.when(~is_blank(f), order)
            aggs.append(F.coalesce(F.max_by(F.col(f), filled),
                                   F.max_by(F.col(f), order)).alias(f))
        else:
            aggs.append(F.max_by(F.col(f), order).alias(f))
    return batch.groupBy(*keys).agg(*aggs).select(*batch.columns)


def next_status(outcome: Column, stored: Column, default: Column) -> Column:
    """new: the source's default.  unchanged: as stored.  changed: rejected
    stays rejected, a trusted source keeps the stored status, everything else
    returns to review."""
    return (F.when(outcome == "new", default)
            .when(outcome == "unchanged", stored)
            .when(stored == "rejected", stored)
            .when(default == "auto", stored)
            .otherwise("pending"))


def merge_observations(staged: DataFrame, batch: DataFrame, seen_at: Column,
                       default_status: Column | str = "pending",
                       keep_unseen: bool = True) -> DataFrame:
    """Next version of the staged rows plus ``outcome``
    (new / changed / unchanged, null for rows the batch did not see).

    A batch row whose hash differs from the stored one takes the stored value
    of every detail field it leaves blank and the stored sold-out flag, and is
    hashed again: a barer observation of the same facts is *unchanged*.

    Write or checkpoint the result before joining it further: its columns are
    wide conditional expressions, which Catalyst would carry as constraints
    through every later join.  ``seen_at`` and ``default_status`` may read columns of the batch.
    ``keep_unseen=False`` returns the batch's rows only (a version delta).
    """
    default = F.lit(default_status) if isinstance(default_status, str) else default_status
    # the batch's fields travel as one struct: renaming two dozen columns under
    # a hash that reads them all would double the join's inferred constraints
    # with every column
    new = batch.select(
        stable_id(F.col("source"), F.col("source_url")).alias("n_id"),
        content_hash().alias("n__hash"), default.alias("n__default"), seen_at.alias("n__at"),
        F.struct(*EVENT_FIELDS).alias("n"))
    both = staged.join(new, F.col("id") == F.col("n_id"),
                       "full_outer" if keep_unseen else "right")
    seen, known = F.col("n_id").isNotNull(), F.col("id").isNotNull()
    differs = seen & known & (F.col("content_hash") != F.col("n__hash"))

    merged = {}
    for f in EVENT_FIELDS:
        mine, theirs = F.col(f"n.{f}"), F.col(f)
        if f in REFILL_FIELDS:
            mine = F.when(differs & _blank(mine, f) & ~_blank(theirs, f), theirs).otherwise(mine)
        elif f == "is_sold_out":
            mine = F.when(differs, mine | F.coalesce(theirs, F.lit(False))).otherwise(mine)
        merged[f] = F.when(seen, mine).otherwise(theirs).alias(f)
    state = both.select(
        F.coalesce("n_id", "id").alias("id"), *merged.values(),
        F.col("content_hash").alias("_stored_hash"), F.col("status").alias("_stored_status"),
        "first_seen", F.col("last_seen").alias("_last"), F.col("updated_at").alias("_updated"),
        "n__default", "n__at", seen.alias("_seen"), known.alias("_known"))
    # only a refilled row needs a second hash, but hashing is cheap next to
    # the join and keeps the plan a single projection
    state = state.withColumn("content_hash", F.when(F.col("_seen"), content_hash())
                             .otherwise(F.col("_stored_hash")))
    outcome = (F.when(~F.col("_seen"), F.lit(None).cast("string"))
               .when(~F.col("_known"), "new")
               .when(F.col("content_hash") == F.col("_stored_hash"), "unchanged")
               .otherwise("changed"))
    state = state.withColumn("outcome", outcome)
    touched = F.col("outcome").isin("new", "changed")
    return state.select(
        "id", *EVENT_FIELDS, "content_hash",
        F.when(F.col("_seen"), next_status(F.col("outcome"), F.col("_stored_status"),
                                           F.col("n__default")))
        .otherwise(F.col("_stored_status")).alias("status"),
        F.coalesce("first_seen", "n__at").alias("first_seen"),
        F.coalesce("n__at", "_last").alias("last_seen"),
        F.when(touched, F.col("n__at")).otherwise(F.col("_updated")).alias("updated_at"),
        "outcome")


def _blank(col: Column, field: str) -> Column:
    if EVENT_SCHEMA[field].dataType.typeName() == "array":
        return col.isNull() | (F.size(col) <= 0)
    return col.isNull()


def empty_stage(spark) -> DataFrame:
    """A staged table without rows.  Backed by an (empty) RDD: a literal empty
    relation would be folded into the merge as one null per column, and
    constraint inference doubles its work with every such column."""
    return spark.createDataFrame(spark.sparkContext.emptyRDD(), STAGED_SCHEMA)


def approve_pending(staged: DataFrame, at: Column, source: str | None = None) -> DataFrame:
    """Pending rows, optionally one source's, become approved.  ``_approved``
    marks them; its sum is the affected count."""
    hit = F.col("status") == "pending"
    if source is not None:
        hit = hit & (F.col("source") == source)
    return _set(staged, hit, "approved", at, "_approved")


def set_status(staged: DataFrame, ids: DataFrame, status: str, at: Column) -> DataFrame:
    """Rows whose id is listed take ``status``.  The list joins by its key,
    so its size does not matter."""
    marked = ids.select("id").distinct().withColumn("_listed", F.lit(True))
    joined = staged.join(marked, "id", "left")
    return _set(joined, F.coalesce("_listed", F.lit(False)), status, at, "_set").drop("_listed")


def _set(staged: DataFrame, hit: Column, status: str, at: Column, mark: str) -> DataFrame:
    return (staged.withColumn(mark, hit)
            .withColumn("status", F.when(F.col(mark), status).otherwise(F.col("status")))
            .withColumn("updated_at", F.when(F.col(mark), at).otherwise(F.col("updated_at"))))


def note_attempts(attempts: DataFrame, fruitless: DataFrame, at: Column) -> DataFrame:
    """Attempt memory after a run: one more where the content is what the
    last attempt saw, back to one where it changed or is new.

    attempts (event_id, attempts, content_hash, last_attempt);
    fruitless (event_id, content_hash), unique per event.
    """
    now = fruitless.select(F.col("event_id").alias("f_id"), F.col("content_hash").alias("f_hash"))
    both = attempts.join(now, F.col("event_id") == F.col("f_id"), "full_outer")
    tried = F.col("f_id").isNotNull()
    again = F.col("content_hash").eqNullSafe(F.col("f_hash"))
    return both.select(
        F.coalesce("event_id", "f_id").alias("event_id"),
        F.when(tried & again, F.col("attempts") + 1).when(tried, 1)
        .otherwise(F.col("attempts")).cast("int").alias("attempts"),
        F.coalesce("f_hash", "content_hash").alias("content_hash"),
        F.when(tried, at).otherwise(F.col("last_attempt")).alias("last_attempt"))


def prune_attempts(attempts: DataFrame, staged: DataFrame, as_of: Column) -> DataFrame:
    """Attempts of finished events are forgotten."""
    over = staged.filter(F.coalesce("end_date", "start_date") < as_of) \
        .select(F.col("id").alias("event_id"))
    return attempts.join(over, "event_id", "left_anti")

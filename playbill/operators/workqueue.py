"""What to fetch next: budgets, backlog, re-checks, stale rows, group order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.operators.ranking import first_per_key, null_safe_join, top_per_key
from playbill.operators.select import any_detail_missing, is_public, no_detail_at_all

DETAIL_BUDGET = 40
FRUITLESS_LIMIT = 2
RECHECK_DAYS = 10
STALE_DAYS = 3
GROUPS_PER_RUN = 25


def with_attempts(staged: DataFrame, attempts: DataFrame) -> DataFrame:
    """Staged rows with their attempt memory."""
    return staged.join(attempts.select(
        F.col("event_id").alias("_eid"), F.col("attempts"),
        F.col("content_hash").alias("tried_hash")), F.col("id") == F.col("_eid"), "left") \
        .drop("_eid")


def backlog(staged: DataFrame, attempts: DataFrame, as_of: Column) -> DataFrame:
    """Never enriched, still to come, worth another look: not rejected, not
    ``other``, and either fewer than two fruitless tries or changed since."""
    given_up = (F.coalesce("attempts", F.lit(0)) >= FRUITLESS_LIMIT) \
        & F.col("tried_hash").eqNullSafe(F.col("content_hash"))
    open_rows = staged.filter((F.col("status") != "rejected") & (F.col("category") != "other")
                              & (F.coalesce("end_date", "start_date") >= as_of)
                              & no_detail_at_all())
    return with_attempts(open_rows, attempts).filter(~given_up).drop("attempts", "tried_hash")


def sold_out_recheck(staged: DataFrame, as_of: Column, days: int = RECHECK_DAYS) -> DataFrame:
    """Near-term music rows that are not marked sold out yet."""
    return staged.filter((F.col("status") != "rejected") & (F.col("category") == "music")
                         & F.col("start_date").between(as_of, F.date_add(as_of, days))
                         & ~F.col("is_sold_out"))


def fresh_work(merged: DataFrame) -> DataFrame:
    """New or changed rows of this run with a detail missing."""
    return merged.filter(F.col("outcome").isin("new", "changed") & any_detail_missing())


def work_queue(tiers: Sequence[tuple[DataFrame, Sequence[Column]]],
               budget: int = DETAIL_BUDGET) -> DataFrame:
    """(source, source_url, id, tier, queue_pos): at most ``budget`` pages per
    source, earlier tiers first, each page once.

    Every tier brings its own order, packed into one sortable struct of
    strings; a page listed in several tiers keeps its first place.
    """
    parts = [rows.select("source", "source_url", "id", F.lit(n).alias("tier"),
                         F.struct(*order).cast("struct<o1:string,o2:string>").alias("ord"))
             for n, (rows, order) in enumerate(tiers, start=1)]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    once = first_per_key(every, ["source", "source_url"], [F.col("tier"), F.col("ord")])
    return top_per_key(once, ["source"], [F.col("tier"), F.col("ord"), F.col("id")],
                       budget, "queue_pos").drop("ord")


def stale_upcoming(staged: DataFrame, as_of: Column, now: Column,
                   days: int = STALE_DAYS) -> DataFrame:
    """Published rows still to come that their source stopped listing."""
    return staged.filter(is_public() & (F.coalesce("end_date", "start_date") >= as_of)
                         & (F.col("last_seen") < now - F.expr(f"INTERVAL {days} DAYS"))) \
        .select("id", "source", "start_date", F.to_date("last_seen").alias("last_seen"),
                F.coalesce("title_ja", "title_en", F.lit("")).alias("title"))


def split_by_group_budget(rows: DataFrame, group: str, date: str,
                          cap: int = GROUPS_PER_RUN) -> DataFrame:
    """Add ``fetch``: true for rows of the ``cap`` groups with the earliest
    date; the others wait as minimal rows.  Only the groups are ranked."""
    groups = rows.groupBy(group).agg(F.min(date).alias("_first"))
    chosen = groups.filter("_first is not null").orderBy("_first", group).limit(cap) \
        .select(group).withColumn("_in", F.lit(True))
    return null_safe_join(rows, chosen, [group], "left") \
        .withColumn("fetch", F.coalesce("_in", F.lit(False))).drop("_in")


def deferred_rows(rows: DataFrame, group: str, date: str) -> DataFrame:
    """One minimal row per (group, date) of the groups that wait."""
    waiting = rows.filter(~F.col("fetch") & F.col(date).isNotNull())
    return waiting.groupBy(group, date).agg(
        F.bool_or("is_sold_out").alias("is_sold_out"), F.min("title_ja").alias("title_ja")) \
        .withColumn("source_url", F.concat(F.col(group), F.lit("#"), F.col(date).cast("string")))


def sort_key() -> list[Column]:
    """Calendar order: date, time (none first), id."""
    return [F.col("start_date"), F.coalesce("start_time", F.lit("")), F.col("id")]

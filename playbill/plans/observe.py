"""A run that stages observations: batch, merge, accounting, next work."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.operators import quality, workqueue
from playbill.operators.merge import collapse_batch, merge_observations, prune_attempts
from playbill.schema import conform
from playbill.session import cut_lineage, sized_broadcast


@dataclass(frozen=True)
class Observed:
    """Results of one run, all lazy over the persisted merge."""

    merged: DataFrame
    counters: DataFrame
    report: DataFrame
    attempts: DataFrame
    queue: DataFrame
    stale: DataFrame


def observe(staged: DataFrame, batch: DataFrame, sources: DataFrame, attempts: DataFrame,
            as_of: Column, now: Column, order: Column) -> Observed:
    """Merge ``batch`` (event rows plus whatever ``order`` reads) into
    ``staged`` and derive what the run reports.

    ``sources`` is (source, default_status, allow_empty, supports_detail).
    """
    ordered = conform(batch.withColumn("_at", order), extra=["_at"])
    collapsed = collapse_batch(ordered, F.col("_at")).drop("_at")
    dim = sized_broadcast(sources.select("source", "default_status"))
    known = collapsed.join(dim, "source", "left")
    merged = cut_lineage(merge_observations(
        staged, known, now, F.coalesce("default_status", F.lit("pending"))))
    counters = quality.run_counters(merged)
    report = quality.run_errors(sources, counters)
    live = prune_attempts(attempts, merged, as_of)
    detailed = merged.join(sources.filter("supports_detail").select("source"), "source", "left_semi")
    queue = workqueue.work_queue(queue_tiers(detailed, live, as_of))
    healthy = report.select("source", "error")
    stale = quality.stale_of_healthy(workqueue.stale_upcoming(merged, as_of, now), healthy)
    return Observed(merged, counters, report, live, queue, stale)


def queue_tiers(merged: DataFrame, attempts: DataFrame, as_of: Column
                ) -> Sequence[tuple[DataFrame, Sequence[Column]]]:
    """New and changed rows, then the backlog by date, then sold-out
    re-checks by date."""
    by_date = [F.col("start_date"), F.col("id")]
    return (
        (workqueue.fresh_work(merged), [F.col("source_url"), F.col("id")]),
        (workqueue.backlog(merged, attempts, as_of), by_date),
        (workqueue.sold_out_recheck(merged, as_of), by_date),
    )

"""Run history and the machine-readable run report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.schema import RUN_SCHEMA, conform


def run_rows(report: DataFrame, gaps: DataFrame, run_id: Column, started: Column,
             finished: Column) -> DataFrame:
    """History rows of one run.  ``gaps`` (source, venue_name) is counted per
    source; the names themselves are ``gap_rows``."""
    names = gap_rows(gaps, run_id).groupBy("source").agg(F.count(F.lit(1)).alias("skipped_venues"))
    joined = report.join(names, "source", "left").select(
        run_id.alias("run_id"), "source", started.alias("started_at"),
        finished.alias("finished_at"), "found", "new", "changed",
        F.col("details").alias("details_fetched"), "error",
        F.coalesce("skipped_venues", F.lit(0)).alias("skipped_venues"))
    return conform(joined, RUN_SCHEMA)


def gap_rows(gaps: DataFrame, run_id: Column) -> DataFrame:
    """(run_id, source, venue_name): names a source could not resolve, each
    once.  Rows, not a list: one source may bring any number of them."""
    return gaps.select(run_id.alias("run_id"), "source", "venue_name").distinct()


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def run_report(report: DataFrame) -> DataFrame:
    """(source, line): one JSON object per source."""
    return report.select("source", F.to_json(
        F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("line"))

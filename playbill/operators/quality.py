"""Run accounting, health, coverage and report tables.

Reports are *line tables* (section, line_no-free sort columns, line): a source
that holds a third of all rows gets many lines, never one long array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("new", "changed", "unchanged")
FAILED_PAGES = 3


def run_counters(merged: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Per source: found and the outcome counts of one run, plus pages fetched."""
    seen = merged.filter("outcome is not null")
    out = seen.groupBy("source").agg(
        F.count(F.lit(1)).alias("found"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    if details is None:
        return out.withColumn("details", F.lit(0).cast("long"))
    fetched = details.groupBy("source").agg(F.count_if("ok").alias("details"),
                                            F.count_if(~F.col("ok")).alias("failed"))
    return out.join(fetched, "source", "full_outer").na.fill(
        0, ["found", *OUTCOMES, "details", "failed"])


def run_errors(registry: DataFrame, counters: DataFrame) -> DataFrame:
    """Per registered source: counters and the error of the run.  Silence is
    an error unless the source may be empty; so is a detail pass that failed
    on three or more pages without one success."""
    joined = registry.join(counters, "source", "left").na.fill(
        0, [c for c in counters.columns if c != "source"])
    failed = F.col("failed") if "failed" in counters.columns else F.lit(0)
    silent = (F.col("found") == 0) & ~F.col("allow_empty")
    broken = (failed >= FAILED_PAGES) & (F.col("details") == 0)
    return joined.withColumn(
        "error", F.when(silent, "0 events parsed — site structure may have changed")
        .when(broken, F.concat(F.lit("detail pass failed for all "), failed.cast("string"),
                               F.lit(" attempted pages"))))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest run per source; an aggregate, so a chatty source costs one row
    per map task."""
    rest = [c for c in runs.columns if c != "source"]
    return runs.groupBy("source").agg(F.max_by(F.struct(*rest), "run_id").alias("_r")) \
        .select("source", "_r.*")


def live_health(health: DataFrame, registry: DataFrame) -> DataFrame:
    """Health rows of sources that are still registered."""
    return health.join(registry.select("source"), "source", "left_semi")


def stale_of_healthy(stale: DataFrame, health: DataFrame) -> DataFrame:
    """Stale rows of sources whose latest run has no error."""
    return stale.join(health.filter("error is null").select("source"), "source", "left_semi")


def failed_sources(health: DataFrame) -> DataFrame:
    return health.filter("error is not null and error <> ''")


def failure_report(health: DataFrame) -> DataFrame:
    """(source, part, line) of the failed sources."""
    lines = F.array(
        F.concat(F.lit("### `"), F.col("source"), F.lit("`")),
        F.format_string("found=%d new=%d changed=%d", "found", "new", "changed"),
        F.trim("error"))
    return failed_sources(health).select("source", F.posexplode(lines).alias("part", "line"))


def gap_report(unresolved: DataFrame) -> DataFrame:
    """(source, part, venue_name, line): a heading per source, then its
    unresolved names in order, each once."""
    names = unresolved.select("source", "venue_name").distinct()
    heads = names.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        "source", F.lit(0).alias("part"), F.lit("").alias("venue_name"),
        F.format_string("### `%s` (%d)", "source", "n").alias("line"))
    return heads.unionByName(names.select(
        "source", F.lit(1).alias("part"), "venue_name",
        F.concat(F.lit("- "), F.col("venue_name")).alias("line")))


def gap_totals(unresolved: DataFrame) -> DataFrame:
    """(names, sources) over all gaps."""
    names = unresolved.select("source", "venue_name").distinct() \
        .groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return names.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("names"),
                     F.count(F.lit(1)).alias("sources"))


def stale_report(stale: DataFrame) -> DataFrame:
    """(source, part, start_date, id, line), a heading and one line per row."""
    heads = stale.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        "source", F.lit(0).alias("part"), F.lit(None).cast("date").alias("start_date"),
        F.lit("").alias("id"), F.format_string("### `%s` (%d)", "source", "n").alias("line"))
    return heads.unionByName(stale.select(
        "source", F.lit(1).alias("part"), "start_date", "id",
        F.format_string("- %s **%s** — last seen %s, id `%s`",
                        F.coalesce(F.col("start_date").cast("string"), F.lit("")), "title",
                        F.col("last_seen").cast("string"), "id").alias("line")))


def merge_counters(fates: DataFrame) -> DataFrame:
    """How many rows met which fate in the export merge."""
    return fates.groupBy("fate").agg(F.count(F.lit(1)).alias("rows"))


def share(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))


def filled(name: str) -> Column:
    return F.col(name).isNotNull()


def listed(name: str) -> Column:
    return F.coalesce(F.size(name) > 0, F.lit(False))


def coverage(events: DataFrame, as_of: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with each fact, and of rows already past; ``by`` adds
    rolled-up totals."""
    metrics = [F.count(F.lit(1)).alias("rows"),
               share(filled("price_min") | filled("is_free")).alias("price"),
               share(filled("start_time")).alias("start_time"),
               share(listed("ticket_links")).alias("ticket_links"),
               share(listed("artists")).alias("artists"),
               share(listed("genres")).alias("genres"),
               share(filled("title_en")).alias("title_en"),
               share(F.coalesce("end_date", "start_date") < as_of).alias("past")]
    return (events.rollup(*by) if by else events.groupBy()).agg(*metrics)


def churn(merged: DataFrame) -> DataFrame:
    """Rows per outcome of one run."""
    return merged.filter("outcome is not null").groupBy("outcome") \
        .agg(F.count(F.lit(1)).alias("rows"))


def capacity_map(events: DataFrame, registry: DataFrame) -> DataFrame:
    """(venue_key, capacity) of the venues present, known values only."""
    present = events.select(F.coalesce("venue_key", "source").alias("venue_key")).distinct()
    return present.join(registry.select("venue_key", "capacity"), "venue_key") \
        .filter("capacity is not null")

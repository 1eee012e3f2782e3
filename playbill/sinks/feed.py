"""The public feed: one compact JSON document, and the same rows as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.operators.select import served
from playbill.sinks.lines import write_lines


#: part number of the event lines
EVENTS = 5


def event_json(events: DataFrame) -> Column:
    """A served row as compact JSON, nulls kept."""
    shown = served(events).columns
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})


def feed_lines(events: DataFrame, health: DataFrame, capacities: DataFrame,
               generated_at: Column) -> DataFrame:
    """(part, start_date, id, line): the lines of the document
    ``{generated_at, sources[], venues{}, events[]}``.

    Every source, venue and event is a line of its own, so the document is
    written in parallel whatever its size.
    """
    stamp = F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    undated = F.lit(None).cast("date")
    sources = health.select(undated.alias("start_date"), F.col("source").alias("id"), F.to_json(
        F.struct("source", "found", "error"), {"ignoreNullFields": "false"}).alias("json"))
    venues = capacities.select(undated.alias("start_date"), F.col("venue_key").alias("id"), F.concat(
        F.to_json(F.map_from_arrays(F.array("venue_key"), F.array(F.struct("capacity"))))).alias("json")) \
        .withColumn("json", F.expr("substring(json, 2, length(json) - 2)"))
    rows = events.select("start_date", "id", event_json(events).alias("json"))

    def fixed(part: int, line: Column) -> DataFrame:
        return events.sparkSession.range(1).select(
            F.lit(part).alias("part"), undated.alias("start_date"), F.lit("").alias("id"),
            line.alias("line"))

    out = fixed(0, F.concat(F.lit('{"generated_at":"'), stamp, F.lit('","sources":[')))
    for more in (_joined(sources, 1), fixed(2, F.lit('],"venues":{')), _joined(venues, 3),
                 fixed(4, F.lit('},"events":[')), _joined(rows, EVENTS), fixed(6, F.lit("]}"))):
        out = out.unionByName(more)
    return out


def _joined(rows: DataFrame, part: int) -> DataFrame:
    """Lines of one list: all but the first in order open with a comma."""
    first = rows.agg(F.min(F.struct("start_date", "id"))).scalar()
    comma = F.when(F.struct("start_date", "id") == first, "").otherwise(",")
    return rows.select(F.lit(part).alias("part"), "start_date", "id",
                       F.concat(comma, "json").alias("line"))


def write_feed(lines: DataFrame, path: str) -> None:
    write_lines(lines, path, ["part", "start_date", "id"])


def write_event_rows(events: DataFrame, path: str) -> None:
    """The served rows for query engines."""
    served(events).write.mode("overwrite").json(path)

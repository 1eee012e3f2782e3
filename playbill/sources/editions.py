"""Curated dated editions to event rows.

editions  edition, source, url, title_ja, title_en, category, dates array<date>,
          start_time, venue_name, contiguous boolean
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Facet of a seasonal category.
SEASONAL_FACET = {"fireworks": "hanabi", "flowers": "flowers", "festival": "matsuri"}


def expand_editions(editions: DataFrame, as_of: Column) -> DataFrame:
    """A contiguous run is one row with a range, any other edition one row
    per date; rows already over are dropped.  The URL carries ``#date`` when
    an edition has several rows."""
    first, last = F.array_min("dates"), F.array_max("dates")
    runs = F.when(F.col("contiguous"), F.array(F.struct(first.alias("start"), last.alias("end")))) \
        .otherwise(F.transform("dates", lambda d: F.struct(d.alias("start"), d.alias("end"))))
    rows = editions.withColumn("_many", F.size(runs) > 1).withColumn("_run", F.explode(runs)) \
        .filter(F.col("_run.end") >= as_of)
    return _rows(rows)


def split_by_day(editions: DataFrame, as_of: Column) -> DataFrame:
    """One row per show day, while the edition as a whole is not over."""
    live = editions.filter(F.array_max("dates") >= as_of)
    rows = live.withColumn("_many", F.size("dates") > 1) \
        .withColumn("_d", F.explode("dates")) \
        .withColumn("_run", F.struct(F.col("_d").alias("start"), F.col("_d").alias("end"))).drop("_d")
    return _rows(rows)


def _rows(rows: DataFrame) -> DataFrame:
    url = F.when(F.col("_many"), F.concat("url", F.lit("#"), F.col("_run.start").cast("string"))) \
        .otherwise(F.col("url"))
    return rows.withColumn("source_url", url) \
        .withColumn("start_date", F.col("_run.start")) \
        .withColumn("end_date", F.nullif(F.col("_run.end"), F.col("_run.start"))) \
        .drop("_many", "_run", "url", "dates", "contiguous")


def seasonal_facet(category: Column) -> Column:
    pairs = [F.lit(x) for kv in SEASONAL_FACET.items() for x in kv]
    return F.array(F.coalesce(F.create_map(*pairs)[category], F.lit("matsuri")))

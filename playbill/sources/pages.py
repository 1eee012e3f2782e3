"""Corpus of raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.functions.text import first_group
from playbill.functions.urls import host_of


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html, source, page_month): the corpus with its context.
    The source is the host without ``www``/``m``; the page's month is what its
    URL says, if anything."""
    pages = spark.read.parquet(path)
    host = F.regexp_replace(host_of(F.col("url")), r"^(?:www|m)\.", "")
    month = F.try_to_date(first_group(F.col("url"), r"(20\d{2})[-/]?(?:0[1-9]|1[0-2])", 0), "yyyyMM")
    return pages.withColumn("source", host).withColumn("page_month", month)


def month_tabs(rows: DataFrame, tabs: DataFrame, page_id: str) -> DataFrame:
    """Rows printed without a year take it from the page's month tabs
    (page_id, month, year)."""
    return rows.join(tabs.select(page_id, "month", "year"), [page_id, "month"], "left")

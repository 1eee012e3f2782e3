"""Curated dimensions: the caller's registry and rule tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.operators.venues import check_registry

REGISTRY = "ord int, venue_key string, display string, vclass string, capacity int"
ALIASES = "ord int, alias string, venue_key string"
SOURCES = ("source string, source_class string, default_status string, "
           "allow_empty boolean, supports_detail boolean")
HOSTS = "festival_key string, host_key string"


def read_registry(spark: SparkSession, venues: str, aliases: str | None = None,
                  ) -> tuple[DataFrame, DataFrame | None]:
    """Venue registry and aliases from CSV files with a header; fails when a
    key repeats or an alias names an unknown venue.  ``ord`` is the curated
    order, which decides prefix matches."""
    reg = spark.read.csv(venues, schema=REGISTRY, header=True)
    ali = None if aliases is None else spark.read.csv(aliases, schema=ALIASES, header=True)
    return _checked(reg, ali), ali


def registry_from_rows(spark: SparkSession, venues: Sequence[tuple],
                       aliases: Sequence[tuple] = ()) -> tuple[DataFrame, DataFrame]:
    reg = spark.createDataFrame(list(venues), REGISTRY)
    ali = spark.createDataFrame(list(aliases), ALIASES)
    return _checked(reg, ali), ali


def _checked(reg: DataFrame, ali: DataFrame | None) -> DataFrame:
    problem = check_registry(reg, ali).first()
    if problem is not None:
        raise ValueError(f"{problem['problem']}: {problem['value']}")
    return reg


def mapping_table(spark: SparkSession, table: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A fixed mapping as a two-column table, in its own order."""
    rows = [(n, k, v) for n, (k, v) in enumerate(table.items())]
    return spark.createDataFrame(rows, f"ord int, {key} string, {value} string")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=SOURCES, header=True) \
        .withColumn("allow_empty", F.coalesce("allow_empty", F.lit(False)))

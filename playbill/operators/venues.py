"""Venue resolution against a registry table.

registry  ord int, venue_key, display, vclass, capacity
aliases   ord int, alias, venue_key

The registry is data the caller loads (``sources.dims``); nothing here
assumes it is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.text import venue_norm
from playbill.operators.ranking import spread_join
from playbill.session import sized_broadcast

SHORTEST_PREFIX = 4


def venue_index(registry: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(norm, ord, venue_key): one row per normalised spelling, registry
    entries before aliases.  A later spelling of the same norm keeps the first
    position but its own key, as a keyed table would."""
    rows = registry.select(F.lit(0).alias("part"), "ord", F.col("display").alias("spelling"),
                           "venue_key")
    if aliases is not None:
        rows = rows.unionByName(aliases.select(
            F.lit(1).alias("part"), "ord", F.col("alias").alias("spelling"), "venue_key"))
    # an empty norm may stay: it is never looked up, and a filter on it would
    # be pushed down and fold every spelling twice
    keyed = rows.withColumn("norm", venue_norm(F.col("spelling")))
    at = F.struct("part", "ord")
    return keyed.groupBy("norm").agg(F.min(at).alias("ord"),
                                     F.max_by("venue_key", at).alias("venue_key"))


def check_registry(registry: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Problems that make a registry unusable; empty when it is sound."""
    twice = registry.groupBy("venue_key").count().filter("count > 1") \
        .select(F.lit("duplicate venue key").alias("problem"), F.col("venue_key").alias("value"))
    if aliases is None:
        return twice
    lost = aliases.join(registry, "venue_key", "left_anti").select(
        F.lit("alias to unknown venue key").alias("problem"), F.col("alias").alias("value"))
    return twice.unionByName(lost)


def resolve_venues(rows: DataFrame, raw: str, index: DataFrame,
                   out: str = "venue_key") -> DataFrame:
    """Add ``out``: exact normalised spelling, else the first registry
    spelling of at least four characters that the name starts with, else null.

    Works on the distinct raw names, so a name a third of the rows carry is
    folded once.  The prefix search is an equi-join on the name's prefixes
    rather than a nested loop over the registry.
    """
    names = rows.select(F.col(raw).alias("_raw")).filter(F.col("_raw").isNotNull()).distinct() \
        .withColumn("_norm", venue_norm(F.col("_raw")))
    small = sized_broadcast(index.select(F.col("norm").alias("_prefix"), "ord",
                                         F.col("venue_key").alias("_key")))
    # the full name is the longest prefix: exact hits and prefix hits come
    # out of one join, exact ones ranked first
    prefixes = names.select(
        "_raw", "_norm", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("_norm")),
            lambda n: F.substring(F.col("_norm"), F.lit(1), n))).alias("_prefix")) \
        .filter((F.length("_prefix") >= SHORTEST_PREFIX)
                | ((F.col("_prefix") == F.col("_norm")) & (F.col("_prefix") != "")))
    hits = prefixes.join(small, "_prefix").groupBy("_raw").agg(F.min_by(
        "_key", F.struct((F.col("_prefix") != F.col("_norm")).alias("late"), "ord")).alias(out))
    # one raw name, or none, may stand in a third of all rows
    return spread_join(rows, hits.withColumnRenamed("_raw", raw), raw, "left")


def add_venue_facts(rows: DataFrame, registry: DataFrame, key: str = "venue_key",
                    facts: Sequence[str] = ("display", "vclass", "capacity")) -> DataFrame:
    dim = sized_broadcast(registry.select(F.col("venue_key").alias("_k"), *facts))
    return rows.join(dim, F.col(key) == F.col("_k"), "left").drop("_k")


def assign_venue_key(rows: DataFrame, index: DataFrame, curated: Sequence[str],
                     promoters: Sequence[str]) -> DataFrame:
    """Curated sources: resolved name, else the source.  Promoters: resolved
    name or null (not displayable).  Venue sources: themselves."""
    resolved = resolve_venues(rows, "venue_name", index, "_resolved")
    source = F.col("source")
    key = (F.when(source.isin(*curated), F.coalesce("_resolved", source))
           .when(source.isin(*promoters), F.col("_resolved"))
           .otherwise(source))
    return resolved.withColumn("venue_key", key).drop("_resolved")


def unresolved_names(rows: DataFrame, raw: str = "venue_name",
                     key: str = "venue_key") -> DataFrame:
    """Distinct raw names without a key, per source."""
    return rows.filter(F.col(key).isNull() & F.col(raw).isNotNull()) \
        .groupBy("source", F.col(raw).alias("venue_name")) \
        .agg(F.count(F.lit(1)).alias("rows"))


def with_venue_identity(key: Column, source: Column) -> Column:
    return F.coalesce(key, source)



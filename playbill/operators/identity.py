"""Stable identity, content hash, and duplicates inside one batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.text import nfkc, no_space
from playbill.operators.ranking import first_per_key, null_safe_join, ordinal_per_key
from playbill.schema import EVENT_FIELDS


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of sha-256 over the parts joined by ``|``."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, 16)


def content_hash(fields: Sequence[str] = EVENT_FIELDS) -> Column:
    """Fingerprint of every field, in name order, nulls included."""
    packed = F.struct(*[F.col(f) for f in sorted(fields)])
    return F.substring(
        F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256), 1, 16)


def title_hash(title: Column) -> Column:
    """Short id from a title, blind to width and white space."""
    return F.substring(F.sha1(nfkc(no_space(title))), 1, 8)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First observation per key in printed order."""
    return first_per_key(df, keys, order)


def keep_richest(df: DataFrame, keys: Sequence[str], text: str,
                 order: Sequence[Column]) -> DataFrame:
    """Longest text per key; the earlier one on a tie."""
    return first_per_key(df, keys, [(-F.length(text)).alias("_len"), *order])


def fragment_repeats(df: DataFrame, url: str, date: str, leg: str | None = None,
                     out: str = "source_url") -> DataFrame:
    """``#date`` on a URL that spans several dates, ``-leg`` as well where a
    date has several legs."""
    per_url = df.groupBy(url).agg(
        F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    tagged = null_safe_join(df, per_url, [url], "inner")
    spans = F.col("_lo") != F.col("_hi")
    suffix = F.when(spans, F.concat(F.lit("#"), F.col(date).cast("string"))).otherwise("")
    if leg is not None:
        per_day = df.groupBy(url, date).agg(F.count(F.lit(1)).alias("_legs"))
        tagged = null_safe_join(tagged, per_day, [url, date], "inner")
        suffix = F.when(F.col("_legs") > 1, F.concat(
            F.lit("#"), F.col(date).cast("string"), F.lit("-"), F.col(leg).cast("string"))) \
            .otherwise(suffix)
    return tagged.withColumn(out, F.concat(F.col(url), F.coalesce(suffix, F.lit("")))) \
        .drop("_lo", "_hi", "_legs")


def ordinal_fragment(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                     date: str, out: str = "fragment") -> DataFrame:
    """The date, with ``-n`` from the second row of a day on."""
    placed = ordinal_per_key(df, keys, order, "_n")
    day = F.col(date).cast("string")
    return placed.withColumn(out, F.when(F.col("_n") == 1, day).otherwise(
        F.concat(day, F.lit("-"), F.col("_n").cast("string")))).drop("_n")


def merge_spans(df: DataFrame, keys: Sequence[str], start: str, end: str,
                title: str, order: Sequence[Column]) -> DataFrame:
    """Stubs of one event across cells and pages: widest dates (an end only
    when it differs from the start) and the longest title, first on a tie."""
    hi = F.max(F.greatest(F.coalesce(F.col(end), F.col(start)), F.col(start)))
    longest = F.min_by(F.col(title), F.struct(
        (-F.length(F.coalesce(F.col(title), F.lit("")))).alias("_len"), *order))
    return df.groupBy(*keys).agg(
        F.min(start).alias(start), hi.alias("_hi"), longest.alias(title)) \
        .withColumn(end, F.nullif(F.col("_hi"), F.col(start))).drop("_hi")


def badge_any(df: DataFrame, keys: Sequence[str], badge: str) -> DataFrame:
    """OR of a badge per key."""
    return df.groupBy(*keys).agg(F.bool_or(F.coalesce(F.col(badge), F.lit(False))).alias(badge))


def spread_badge(legs: DataFrame, listing: DataFrame, keys: Sequence[str],
                 badge: str) -> DataFrame:
    """Legs take their own badge OR the listing's for the same key."""
    seen = badge_any(listing, keys, badge).withColumnRenamed(badge, "_seen")
    return null_safe_join(legs, seen, keys, "left").withColumn(
        badge, F.coalesce(F.col(badge), F.lit(False)) | F.coalesce("_seen", F.lit(False))) \
        .drop("_seen")

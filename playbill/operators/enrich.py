"""Joining facts from other pages onto event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.flags import is_sold_out
from playbill.functions.prices import price_floor, price_zone, without_drink_charges
from playbill.functions.text import squeeze
from playbill.functions.times import open_start
from playbill.schema import LINKS

# Entries that are not acts in a festival bill.
NON_ACTS = ("TBA", "TBD", "COMING SOON", "AND MORE", "＆MORE", "& MORE")


def detail_facts(pages: DataFrame, url: str = "url", text: str = "text",
                 links: str | None = None) -> DataFrame:
    """Facts of a detail page: times, price in the marked zone, links,
    sold-out.  One projection over the page text."""
    opening, start = open_start(F.col(text))
    price = price_floor(without_drink_charges(price_zone(F.col(text))))
    found = F.array().cast(LINKS) if links is None else F.col(links)
    return pages.select(
        F.col(url).alias("d_url"), opening.alias("d_open_time"), start.alias("d_start_time"),
        price["price_text"].alias("d_price_text"), price["price_min"].alias("d_price_min"),
        price["is_free"].alias("d_is_free"), found.alias("d_ticket_links"),
        is_sold_out(F.col(text)).alias("d_is_sold_out"))


def enrich(events: DataFrame, details: DataFrame, overwrite: Sequence[str] = ()) -> DataFrame:
    """Fill, don't overwrite: times only when both are missing, the price
    group only without a floor, links only when there are none, sold-out by
    OR.  Fields named in ``overwrite`` take the page's value when it has one
    (``d_<field>`` must be in ``details``)."""
    joined = events.join(details, F.col("source_url") == F.col("d_url"), "left")
    timeless = F.col("open_time").isNull() & F.col("start_time").isNull()
    unpriced = F.col("price_min").isNull() & F.col("d_url").isNotNull()
    no_links = F.coalesce(F.size("ticket_links") <= 0, F.lit(True))
    new = {
        "open_time": F.when(timeless, F.col("d_open_time")).otherwise(F.col("open_time")),
        "start_time": F.when(timeless, F.col("d_start_time")).otherwise(F.col("start_time")),
        "price_text": F.when(unpriced, F.col("d_price_text")).otherwise(F.col("price_text")),
        "price_min": F.coalesce("price_min", "d_price_min"),
        "is_free": F.when(unpriced, F.col("d_is_free")).otherwise(F.col("is_free")),
        "ticket_links": F.when(no_links, F.coalesce("d_ticket_links", "ticket_links"))
        .otherwise(F.col("ticket_links")),
        "is_sold_out": F.col("is_sold_out") | F.coalesce("d_is_sold_out", F.lit(False)),
    }
    for f in overwrite:
        new[f] = _prefer(F.col(f"d_{f}"), F.col(f), joined.schema[f].dataType.typeName() == "array")
    # one projection, so no field sees another's new value
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in events.columns])


def _prefer(page: Column, own: Column, is_list: bool) -> Column:
    have = F.size(page) > 0 if is_list else page.isNotNull()
    return F.when(have, page).otherwise(own)


def mirror_titles(listing: DataFrame, mirror: DataFrame, keys: Sequence[str],
                  title: str = "title_ja", other: str = "title_en") -> DataFrame:
    """Second-language title by slug; dropped where it equals the first."""
    named = mirror.select(*keys, F.col(other).alias("_t"))
    return listing.join(named, list(keys), "left") \
        .withColumn(other, F.nullif("_t", F.col(title))).drop("_t")


def dated_by_detail(listing: DataFrame, details: DataFrame, url: str) -> DataFrame:
    """Listing rows whose dates come from their detail page; rows that end up
    without a start are dropped.  ``details`` is (url, d_start, d_end)."""
    return listing.join(details, url, "left") \
        .withColumn("start_date", F.coalesce("start_date", "d_start")) \
        .withColumn("end_date", F.coalesce("end_date", "d_end")) \
        .drop("d_start", "d_end").filter("start_date is not null")


def clean_bill(names: Column) -> Column:
    """Acts of a bill in order: spaces collapsed, placeholders and repeats out."""

    tidy = F.transform(names, lambda n: squeeze(F.coalesce(n, F.lit(""))))
    return F.array_distinct(F.filter(tidy, lambda n: (n != "") & ~F.upper(n).isin(*NON_ACTS)))


def bill_by_column(editions: DataFrame, cells: DataFrame) -> DataFrame:
    """Bills printed in columns: column i belongs to the edition's i-th date.
    cells (edition, col, pos, name)."""
    days = editions.select("edition", F.posexplode("dates").alias("col", "day"))
    return _bills(days.join(cells, ["edition", "col"]))


def bill_by_code(editions: DataFrame, acts: DataFrame, form: str = "MMdd") -> DataFrame:
    """Bills that carry date codes: matched by formatting the edition's dates.
    acts (edition, code, pos, name)."""
    days = editions.select("edition", F.explode("dates").alias("day")) \
        .withColumn("code", F.date_format("day", form))
    return _bills(days.join(acts, ["edition", "code"]))


def _bills(rows: DataFrame) -> DataFrame:
    """(edition, day, lineup): printed order, each act once.  A bill is the
    acts of one day of one edition."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))),
                          lambda s: s["name"])
    return rows.groupBy("edition", "day").agg(ordered.alias("_names")) \
        .select("edition", "day", clean_bill(F.col("_names")).alias("lineup"))


def with_bills(skeletons: DataFrame, bills: DataFrame) -> DataFrame:
    """Skeleton rows keep an empty line-up where no bill is known."""
    return skeletons.drop("lineup").join(
        bills.withColumnRenamed("day", "start_date"), ["edition", "start_date"], "left") \
        .withColumn("lineup", F.coalesce("lineup", F.array().cast("array<string>")))

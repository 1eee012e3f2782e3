"""Filters, listings and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.schema import PUBLIC_STATUSES, UNSERVED_FIELDS


def is_public(status: Column | None = None) -> Column:
    return (F.col("status") if status is None else status).isin(*PUBLIC_STATUSES)


def list_events(staged: DataFrame, status: str | None = None, category: str | None = None,
                date_from: Column | None = None, date_to: Column | None = None,
                public_only: bool = False, ordered: bool = True) -> DataFrame:
    """The listing query; every given condition is a plain column predicate
    and reaches the Parquet scan.  Ties on the date are ordered by id."""
    out = staged
    if public_only:
        out = out.filter(is_public())
    if status is not None:
        out = out.filter(F.col("status") == status)
    if category is not None:
        out = out.filter(F.col("category") == category)
    if date_from is not None:
        out = out.filter(F.col("start_date") >= date_from)
    if date_to is not None:
        out = out.filter(F.col("start_date") <= date_to)
    return out.orderBy("start_date", "id") if ordered else out


def upcoming(events: DataFrame, as_of: Column) -> DataFrame:
    """Running or still to come, dated, and not in category ``other``."""
    return events.filter((F.coalesce("end_date", "start_date") >= as_of)
                         & (F.col("category") != "other"))


def within_horizon(events: DataFrame, as_of: Column, months: int,
                   date: str = "start_date") -> DataFrame:
    """From ``as_of`` to the end of the window of ``months`` whole months."""
    last = F.add_months(F.trunc(as_of, "MM"), months)
    return events.filter((F.col(date) >= as_of) & (F.col(date) < last))


def served(events: DataFrame, drop: Sequence[str] = UNSERVED_FIELDS) -> DataFrame:
    return events.drop(*drop)


def any_detail_missing() -> Column:
    """Run-time rule: something is still worth fetching."""
    return (_no_links() | F.col("start_time").isNull() | F.col("price_min").isNull())


def no_detail_at_all() -> Column:
    """Backlog rule: nothing was ever found (a free event counts as found)."""
    return (_no_links() & F.col("start_time").isNull() & F.col("price_min").isNull()
            & F.col("is_free").isNull())


def _no_links() -> Column:
    return F.coalesce(F.size("ticket_links") <= 0, F.lit(True))


def scope_gate(rows: DataFrame, resolved: str, in_scope: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, gaps): rows with a resolved key; unresolved rows inside the
    scope, which are curation gaps.  Unresolved rows outside it are silent."""
    return (rows.filter(F.col(resolved).isNotNull()),
            rows.filter(F.col(resolved).isNull() & F.coalesce(in_scope, F.lit(False))))


def union_new(chosen: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``chosen`` plus the rows of ``more`` whose key it does not hold."""
    fresh = more.join(chosen.select(*keys).distinct(), list(keys), "left_anti")
    return chosen.unionByName(fresh, allowMissingColumns=True)


def union_links(mine: Column, theirs: Column) -> Column:
    """Own links, then the other side's whose URL is not there yet.  Links
    without a URL are never taken over."""
    own = F.coalesce(mine, F.array().cast("array<struct<provider:string,url:string,code:string>>"))
    urls = F.transform(own, lambda t: t["url"])
    extra = F.filter(F.coalesce(theirs, F.lit(None).cast(
        "array<struct<provider:string,url:string,code:string>>")),
        lambda t: t["url"].isNotNull() & ~F.coalesce(F.array_contains(urls, t["url"]),
                                                     F.lit(False)))
    unique = F.aggregate(
        F.coalesce(extra, F.array().cast("array<struct<provider:string,url:string,code:string>>")),
        F.array().cast("array<struct<provider:string,url:string,code:string>>"),
        lambda acc, t: F.when(F.exists(acc, lambda a: a["url"] == t["url"]), acc)
        .otherwise(F.concat(acc, F.array(t))))
    return F.concat(own, unique)


def unknown_sources(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """Source ids that are not registered."""
    return asked.select("source").distinct().join(registry.select("source"), "source", "left_anti")


def involves(sources: Column, of_interest: Sequence[str]) -> Column:
    """The set of sources meets the given one."""
    return F.arrays_overlap(sources, F.array(*[F.lit(s) for s in of_interest]))


def first_by_date(events: DataFrame, n: int) -> DataFrame:
    """Soonest ``n`` rows; a bounded top-k, not a full sort."""
    return events.orderBy("start_date", "id").limit(n)

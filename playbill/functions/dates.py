"""Dates out of text, and years for dates printed without one.

ANSI mode makes ``make_date`` and casts raise on 30 February, so every
candidate goes through ``try_to_date`` and an impossible one is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.text import all_groups, first_group, let

# How dates are printed.
FULL_DATE = r"(?U)(20\d{2})[./年\s]{1,2}(\d{1,2})[./月\s]{1,2}(\d{1,2})"
MONTH_DAY = (r"(?iU)(\d{1,2})\s*[./]\s*(\d{1,2})\s*[(（]?"
             r"(sun|mon|tue|wed|thu|fri|sat|日|月|火|水|木|金|土)")
#: year optional; kanji, dotted and slash forms of one range hit
RANGE_FORMS = {
    "kanji": r"(?U)(?:(20\d{2})\s*年)?\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日",
    "dotted": r"(?U)(?:(20\d{2})\.)?\s*(\d{1,2})\.\s*(\d{1,2})(?!\d)",
    "slash": r"(?U)(?:(20\d{2})/)?(\d{1,2})/(\d{1,2})(?!\d)",
}
MACHINE_DATE = r'datetime="(\d{4}-\d{2}-\d{2})'
LONGEST_RUN_DAYS = 3 * 365


def ymd(year: Column, month: Column, day: Column) -> Column:
    """A date, or null when a part is missing or there is no such day."""
    text = F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string"))
    return F.try_to_date(text, "y-M-d")


def _int(col: Column) -> Column:
    return col.try_cast("int")


def _around(anchor: Column, month: Column, day: Column) -> Column:
    """The date in the year before, of and after the anchor."""
    return F.array(*[ymd(F.year(anchor) + step, month, day) for step in (-1, 0, 1)])


def forward_year(month: Column, day: Column, as_of: Column) -> Column:
    """Schedules look forward: the first candidate year that puts the date
    between 60 days before and 320 days after ``as_of``."""
    fits = F.filter(_around(as_of, month, day),
                    lambda d: F.datediff(d, as_of).between(-60, 320))
    return F.try_element_at(fits, F.lit(1))


def nearest_year(month: Column, day: Column, anchor: Column) -> Column:
    """The candidate year closest to ``anchor``; a tie takes the earlier."""
    known = F.filter(_around(anchor, month, day), lambda d: d.isNotNull())
    ranked = F.transform(known, lambda d: F.struct(
        F.abs(F.datediff(d, anchor)).alias("gap"), d.alias("date")))
    return F.array_min(ranked)["date"]


def text_date(text: Column, as_of: Column) -> Column:
    """First full date; without one, the first month/day with a weekday, in
    the year ``forward_year`` gives.  A full date that cannot be is null and
    is not replaced by a later guess."""
    year, month, day = (_int(first_group(text, FULL_DATE, g)) for g in (1, 2, 3))
    m, d = (_int(first_group(text, MONTH_DAY, g)) for g in (1, 2))
    return F.when(year.isNotNull(), ymd(year, month, day)) \
        .otherwise(F.when(m.isNotNull(), forward_year(m, d, as_of)))


def header_year(month: Column, day: Column, year: Column, header_month: Column) -> Column:
    """Year by a page header's month: more than six months ahead of it is
    last year, more than six behind is next year."""
    gap = month - header_month
    shift = F.when(gap > 6, -1).when(gap < -6, 1).otherwise(0)
    return ymd(year + shift, month, day)


def date_range(text: Column, form: str) -> Column:
    """First two dates of one printing form as ``struct(start, end)``.

    The start must print its year; an end without one takes the start's, or
    the next when it would run backwards.  Inverted or over-long runs are
    null."""
    pattern = RANGE_FORMS[form]
    hits = F.struct(*[F.transform(F.slice(all_groups(text, pattern, g), 1, 2), lambda v: _int(v))
                      .alias(n) for g, n in enumerate("ymd", 1)])

    def candidates(hit: Column) -> Column:
        (y1, y2), (m1, m2), (d1, d2) = [
            [F.get(hit[n], i) for i in (0, 1)] for n in "ymd"]
        # an end without a year keeps its month and day in the next year,
        # so 29 February may have none
        return F.struct(ymd(y1, m1, d1).alias("start"), y2.isNull().alias("bare"),
                        ymd(F.coalesce(y2, y1), m2, d2).alias("same"),
                        ymd(y1 + 1, m2, d2).alias("later"))

    return let(let(hits, candidates), lambda c: _sane(
        c["start"], F.when(c["bare"] & (c["same"] < c["start"]), c["later"]).otherwise(c["same"])))


def _sane(start: Column, end: Column) -> Column:
    return F.when(F.datediff(end, start).between(0, LONGEST_RUN_DAYS),
                  F.struct(start.alias("start"), end.alias("end")))


def machine_range(html: Column) -> Column:
    """First two machine-readable ``datetime`` attributes."""
    hits = F.transform(all_groups(html, MACHINE_DATE), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    return let(hits, lambda h: _sane(F.get(h, 0), F.get(h, 1)))


def any_range(text: Column, html: Column | None = None) -> Column:
    """Machine pair first, then kanji, dotted and slash forms."""
    forms = [date_range(text, form) for form in RANGE_FORMS]
    if html is not None:
        forms.insert(0, machine_range(html))
    return F.coalesce(*forms)


def span_of(dates: Column) -> Column:
    """``struct(start, end)`` over an array of dates; one day has no end."""
    start, end = F.array_min(dates), F.array_max(dates)
    return F.struct(start.alias("start"), F.nullif(end, start).alias("end"))


def every_day(start: Column, end: Column) -> Column:
    """All days of a run; a missing end means one day."""
    last = F.greatest(F.coalesce(end, start), start)
    return F.when(start.isNotNull(), F.sequence(start, last))


def local_day(ts: Column, offset: str = "+09:00") -> Column:
    """Calendar day of a UTC instant in a fixed offset (no zone rules)."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), offset))


def rollover_years(months: Column, first_year: Column) -> Column:
    """Years of the months printed one after the other on a page: a month
    smaller than the one before it starts the next year."""
    drops = F.transform(months, lambda m, i: F.when(
        (i > 0) & (m < F.get(months, i - 1)), 1).otherwise(0))
    return F.transform(drops, lambda d, i: first_year + F.aggregate(
        F.slice(drops, 1, i + 1), F.lit(0), lambda acc, x: acc + x))

"""Calendar files: every music event, and one calendar per venue."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill.operators.identity import stable_id
from playbill.schema import MUSIC_CATEGORIES
from playbill.sinks.lines import write_lines

LINE_OCTETS = 75
UID_DOMAIN = "playbill"
PRODUCT = "-//playbill//JP"
ALL = "events"
#: calendar head and foot (RFC 5545; fixed UTC+9 zone)
HEAD = ("BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{PRODUCT}", "CALSCALE:GREGORIAN")
ZONE = ("X-WR-TIMEZONE:Asia/Tokyo", "BEGIN:VTIMEZONE", "TZID:Asia/Tokyo", "BEGIN:STANDARD",
        "DTSTART:19700101T000000", "TZOFFSETFROM:+0900", "TZOFFSETTO:+0900", "TZNAME:JST",
        "END:STANDARD", "END:VTIMEZONE")


def escape_text(text: Column) -> Column:
    """Text value escaping: backslash first, line breaks last."""
    steps = (("\r\n", "\n"), ("\r", "\n"), ("\\", "\\\\"), (";", "\\;"), (",", "\\,"),
             ("\n", "\\n"))
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


@F.pandas_udf(T.StringType())
def _fold_udf(lines: pd.Series) -> pd.Series:
    return lines.map(_fold, na_action="ignore")


def _fold(line: str) -> str:
    """Cut by octets, never inside a character; continuation lines start with
    one space, which counts."""
    out, room = [""], LINE_OCTETS
    for char in line:
        size = len(char.encode("utf-8"))
        if size > room:
            out.append("")
            room = LINE_OCTETS - 1
        out[-1] += char
        room -= size
    return "\r\n ".join(out)


def fold_line(line: Column) -> Column:
    """Lines over 75 octets are folded; the others never leave the JVM."""
    return F.coalesce(_fold_udf(F.when(F.octet_length(line) > LINE_OCTETS, line)), line)


def uid() -> Column:
    return F.concat(stable_id(F.col("source"), F.col("source_url")), F.lit(f"@{UID_DOMAIN}"))


def entry_lines(now: Column) -> Column:
    """Unfolded property lines of one event, in order."""
    stamp = F.date_format(now, "yyyyMMdd'T'HHmmss'Z'")
    day = F.date_format("start_date", "yyyyMMdd")
    after = F.date_format(F.date_add(F.coalesce("end_date", "start_date"), 1), "yyyyMMdd")
    timed = F.coalesce(F.col("start_time"), F.lit("")) != ""
    clock = F.concat(F.replace("start_time", F.lit(":"), F.lit("")), F.lit("00"))
    title = F.concat(F.coalesce(F.nullif("title_ja", F.lit("")), "title_en", F.lit("")),
                     F.when(F.col("is_sold_out"), " [SOLD OUT]").otherwise(""))
    acts = F.array_join(F.coalesce("artists", F.array().cast("array<string>")), ", ")
    price = F.when(F.coalesce("price_min", F.lit(0)) != 0,
                   F.concat(F.lit("¥"), F.format_number("price_min", 0), F.lit("~"))) \
        .when(F.coalesce("is_free", F.lit(False)), "Free")
    notes = F.array_join(F.array_compact(F.array(F.nullif(acts, F.lit("")), price)), "\n")

    def prop(name: str, value: Column, given: Column) -> Column:
        return F.when(given, F.concat(F.lit(name), value))

    return F.array_compact(F.array(
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), uid()),
        F.concat(F.lit("DTSTAMP:"), stamp),
        prop("DTSTART;TZID=Asia/Tokyo:", F.concat(day, F.lit("T"), clock), timed),
        prop("DTSTART;VALUE=DATE:", day, ~timed),
        prop("DTEND;VALUE=DATE:", after, ~timed),
        F.concat(F.lit("SUMMARY:"), escape_text(title)),
        prop("LOCATION:", escape_text(F.col("venue_name")),
             F.coalesce("venue_name", F.lit("")) != ""),
        prop("DESCRIPTION:", escape_text(notes), notes != ""),
        prop("URL:", F.col("source_url"), F.col("source_url").rlike("^https?://")),
        F.lit("END:VEVENT")))


def relevant(events: DataFrame) -> DataFrame:
    """Dated music events."""
    return events.filter(F.col("category").isin(*MUSIC_CATEGORIES) & F.col("start_date").isNotNull())


def calendar_lines(events: DataFrame, now: Column, title: str = "Events") -> DataFrame:
    """(calendar, part, start_date, start_time, uid, line_no, line) of the
    calendar of all events and of one per venue.

    A venue calendar's name uses the first non-null venue name in calendar
    order.  Each line is a row: a venue with a third of all events is just
    many rows, ordered by the sort columns when written.
    """
    rows = relevant(events).withColumn("venue", F.coalesce("venue_key", "source")) \
        .withColumn("_time", F.coalesce("start_time", F.lit(""))).withColumn("_uid", uid())
    own = rows.select("start_date", "_time", "_uid", "venue",
                      F.posexplode(entry_lines(now)).alias("line_no", "line"))
    body = own.withColumn("calendar", F.explode(F.array(
        F.lit(ALL), F.concat(F.lit("ical/"), F.col("venue"))))).drop("venue")
    names = rows.groupBy("venue").agg(F.min_by(
        "venue_name", F.when(F.coalesce("venue_name", F.lit("")) != "",
                             F.struct("start_date", "_time", "_uid"))).alias("_name")) \
        .select(F.concat(F.lit("ical/"), F.col("venue")).alias("calendar"), F.concat(
            F.lit(f"{title} — "), F.coalesce("_name", "venue")).alias("_title"))
    one = events.sparkSession.range(1).select(F.lit(ALL).alias("calendar"), F.lit(title).alias("_title"))
    frame = names.unionByName(one)
    head = frame.select("calendar", F.lit(0).alias("part"), F.posexplode(F.array(
        *[F.lit(x) for x in HEAD], F.concat(F.lit("X-WR-CALNAME:"), escape_text(F.col("_title"))),
        *[F.lit(x) for x in ZONE])).alias("line_no", "line"))
    tail = frame.select("calendar", F.lit(2).alias("part"), F.lit(0).alias("line_no"),
                        F.lit("END:VCALENDAR").alias("line"))
    every = body.withColumn("part", F.lit(1)) \
        .unionByName(head, allowMissingColumns=True).unionByName(tail, allowMissingColumns=True)
    return every.select("calendar", "part", "start_date", F.col("_time").alias("start_time"),
                        F.col("_uid").alias("uid"), "line_no", fold_line(F.col("line")).alias("line"))


def write_calendars(lines: DataFrame, path: str) -> None:
    """One folder per calendar; CRLF line ends as the format asks."""
    write_lines(lines, path, ["part", "start_date", "start_time", "uid", "line_no"],
                by=["calendar"], sep="\r\n")

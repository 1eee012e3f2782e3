"""Clock times out of announcement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.text import first_group, let

_CLOCK = r"(\d{1,2}:\d{2})"
# Label conventions of schedule pages.
BOTH_LABELS = r"(?iU)OPEN\s*/\s*START[\]】\s]*" + _CLOCK
OPEN_LABEL = r"(?iU)\[?OPEN[\]】\s:]*" + _CLOCK
START_LABEL = r"(?iU)\[?START[\]】\s:]*" + _CLOCK
PAIR_AFTER_LABELS = r"(?iU)OPEN\s*/\s*START[\]】\s]*(\d{1,2}:\d{2})\s*/\s*(\d{1,2}:\d{2})"
TIME_PAIR = r"(?U)(\d{1,2}:\d{2})\s*[/／~〜-]\s*(\d{1,2}:\d{2})"
DOORS_MARK, SHOW_MARK = "開場", "開演|開始"


def open_start(text: Column, pair_first: bool = False) -> tuple[Column, Column]:
    """(open, start).  One time printed after a joint OPEN/START label counts
    for both.  ``pair_first`` reads two printed times as a pair instead."""
    joint = first_group(text, BOTH_LABELS)
    opening = F.coalesce(joint, first_group(text, OPEN_LABEL))
    start = F.coalesce(joint, first_group(text, START_LABEL))
    if pair_first:
        opening = F.coalesce(first_group(text, PAIR_AFTER_LABELS, 1), opening)
        start = F.coalesce(first_group(text, PAIR_AFTER_LABELS, 2), start)
    return opening, start


def clock(hour: Column, minute: Column) -> Column:
    return F.format_string("%02d:%02d", hour.cast("int"), minute.cast("int"))


def time_variants(text: Column) -> tuple[Column, Column]:
    """(open, start) over the layouts seen on listing pages, first rule wins:
    first "open/start" pair (also the first stage of a two-stage show),
    12-hour clock, kanji clock, tip-off time as a lone start."""
    pair_open, pair_start = (first_group(text, TIME_PAIR, g) for g in (1, 2))
    kanji_open = _kanji(text, DOORS_MARK)
    kanji_start = _kanji(text, SHOW_MARK)
    tip_off = first_group(text, r"(?iU)(?:TIP[ -]?OFF|試合開始)\D{0,6}" + _CLOCK)
    return (F.coalesce(_half_day(text, "open"), pair_open, kanji_open),
            F.coalesce(_half_day(text, "start"), pair_start, kanji_start, tip_off))


def _half_day(text: Column, label: str) -> Column:
    pattern = rf"(?iU){label}\s*(\d{{1,2}}):(\d{{2}})\s*([ap])m"
    hour = first_group(text, pattern, 1).try_cast("int")
    noon = F.when(F.lower(first_group(text, pattern, 3)) == "p", 12).otherwise(0)
    h24 = F.pmod(hour, F.lit(12)) + noon
    return F.concat(F.lpad(h24.cast("string"), 2, "0"), F.lit(":"), first_group(text, pattern, 2))


def _kanji(text: Column, label: str) -> Column:
    pattern = rf"(?U)(?:{label})[^0-9]{{0,4}}(\d{{1,2}})時(?:(\d{{1,2}})分|(半))?"
    minute = F.coalesce(first_group(text, pattern, 2),
                        F.when(first_group(text, pattern, 3).isNotNull(), "30"),
                        F.lit("00"))
    return F.concat(first_group(text, pattern, 1), F.lit(":"), F.lpad(minute, 2, "0"))


def labelled_times(text: Column) -> tuple[Column, Column]:
    """(open, start) by position: each label takes the nearest printed time
    (by character gap), and a time the open label took is not offered to the
    start label.  Works for "開場17:00" and "17:00開場" alike.

    The text is walked once: split at the clock times, so the pieces between
    them carry the offsets; no row-wise Python.
    """
    hits = F.regexp_extract_all(text, F.lit(r"\d{1,2}:\d{2}"), F.lit(0))
    pieces = F.split(text, r"\d{1,2}:\d{2}")
    # start offset of hit i = length of pieces 0..i plus length of hits 0..i-1
    spans = F.transform(hits, lambda hit, i: F.struct(
        (_total(F.slice(pieces, 1, i + 1)) + _total(F.slice(hits, 1, i))).alias("at"),
        F.length(hit).alias("len"), hit.alias("hit"), i.alias("i")))
    def pick(found: Column) -> Column:
        return let(_nearest(text, found, DOORS_MARK), lambda o: F.struct(
            o["hit"].alias("open"), _nearest(text, F.filter(
                found, lambda s: ~F.equal_null(s["i"], o["i"])), SHOW_MARK)["hit"].alias("start")))

    times = let(spans, pick)
    return times["open"], times["start"]


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.length(p))


def _nearest(text: Column, spans: Column, mark: str) -> Column:
    at = F.regexp_instr(text, F.lit(mark)) - 1
    size = F.length(F.regexp_extract(text, mark, 0))
    ranked = F.transform(spans, lambda s: F.struct(
        F.greatest(F.lit(0), at - (s["at"] + s["len"]), s["at"] - (at + size)).alias("gap"),
        s["i"].alias("i"), s["hit"].alias("hit")))
    return F.when(at >= 0, F.array_min(ranked))


def minutes_before(time: Column, minutes: int | Column) -> Column:
    """Clock time ``minutes`` earlier, wrapping at midnight."""
    total = (F.split(time, ":")[0].cast("int") * 60 + F.split(time, ":")[1].cast("int")
             - F.lit(minutes))
    return let(F.pmod(total, F.lit(24 * 60)), lambda t: F.when(
        t.isNotNull(), clock(F.floor(t / 60), F.pmod(t, F.lit(60)))))


def doors_from_note(text: Column, start: Column) -> Column:
    """Opening time where the text only says how long before the start the
    doors open ("開場は開演の30分前")."""
    return minutes_before(start, first_group(
        text, r"(?U)開場[^0-9]{0,8}?(\d{1,3})分前").try_cast("int"))

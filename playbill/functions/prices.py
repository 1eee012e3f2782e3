"""Price floors out of announcement text.

``price_floor`` is the plain reading; ``price_by_policy`` is one operator for
the per-site conventions, each described by a ``PricePolicy`` row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.text import all_groups, first_group, let, nfkc, squeeze

# How amounts, surcharges and admission are printed.
YEN_PREFIX = r"(?U)[¥￥]\s*([\d,，]+)"
YEN_SUFFIX = (r"(?iU)(?<![¥￥\d,，.])(\d{1,3}(?:[,，]\d{3})+|\d{3,5})\s*円"
              r"(?!\s*(?:引|OFF|オフ|分))")
YEN_EITHER = r"(?U)[¥￥]\s*[\d,，]+|[\d,，]+\s*円"
YEN_TAX_INCLUDED = r"(?U)[¥￥]\s*([\d,]+)\s*[(（]\s*税込\s*[)）]"
DRINK_CHARGE = (r"(?iU)(?:別途)?\s*(?:[1１]?ドリンク代?|DRINK|[1１]D(?:RINK)?代?|Ｄ代|D代)\s*"
                r"(?:別途|別|代)?\s*[:：]?\s*[¥￥]?\s*[\d,，]{3,}\s*(?:円)?")
SUFFIX_FLOOR = 300
PRICE_ZONE = r"(?is)(?:ADV|前売|料金|TICKET|チケット)(.{0,250})"
ZONE_CUT = r"(?i)GOODS|グッズ|物販|INFO|お問い合わせ"
FREE_WORDS = r"無料"
ADMISSION_LABEL = r"入館料|入場料|観覧料|チケット・料金|チケットの?料金|料金"
STRICT_LABEL = r"^(?:入館料|入場料|観覧料)$"
ADULT_THEN_PRICE = r"一般[^0-9]{0,12}([0-9][0-9,，]{2,6})\s*円?"
PRICE_THEN_ADULT = r"([0-9][0-9,，]{2,6})\s*円\s*[（(]\s*一般"
ANY_ADMISSION = r"([0-9][0-9,，]{2,6})\s*円"
FREE_ADMISSION = r"(?:入場|入館|観覧)無料"

PRICE_TYPE = "struct<price_text:string,price_min:int,is_free:boolean>"


def to_amount(digits: Column) -> Column:
    """Digits with separators, any width, as int; null when not a number."""
    plain = F.regexp_replace(F.translate(digits, "０１２３４５６７８９", "0123456789"),
                             r"[^0-9]", "")
    return plain.try_cast("int")


def _amounts(found: Column) -> Column:
    return F.filter(F.transform(found, to_amount), lambda v: v.isNotNull())


def without_drink_charges(text: Column) -> Column:
    return F.regexp_replace(text, DRINK_CHARGE, " ")


def price_struct(text: Column, floor: Column, free: Column) -> Column:
    return F.struct(text.alias("price_text"), floor.cast("int").alias("price_min"),
                    free.alias("is_free"))


def price_floor(text: Column) -> Column:
    """``struct(price_text, price_min, is_free)`` over every prefixed amount
    and every suffixed one of at least 300; all null without an amount."""
    prefixed = _amounts(all_groups(text, YEN_PREFIX))
    suffixed = F.filter(_amounts(all_groups(text, YEN_SUFFIX)), lambda v: v >= SUFFIX_FLOOR)
    shown = squeeze(text)
    return let(F.array_min(F.concat(prefixed, suffixed)), lambda floor: F.when(
        floor.isNotNull(), price_struct(shown, floor, floor == 0)))


def price_zone(text: Column) -> Column:
    """The 250 characters after a price marker up to a merchandise or
    contact marker; the whole text when no marker is printed."""
    zone = F.coalesce(first_group(text, PRICE_ZONE), text)
    return F.element_at(F.split(zone, ZONE_CUT, 2), 1)


@dataclass(frozen=True)
class PricePolicy:
    """How one site prints prices.

    zone        text after this pattern's first match (group 1); whole text if null
    cut         the zone ends here
    amount      pattern whose match holds one amount (group ``group``)
    fallback    used when ``amount`` finds nothing
    leading     only the first amount of each line counts
    first_only  only the first amount of the zone counts
    keep_line / drop_line   line filters
    strip       removed before reading (surcharges, bracketed notes)
    yen_alias   pattern rewritten to a yen sign (backslash on old pages)
    free        words that mean free when no amount is printed
    """

    name: str
    zone: str | None = None
    cut: str | None = None
    amount: str = YEN_EITHER
    group: int = 0
    fallback: str | None = None
    leading: bool = False
    first_only: bool = False
    keep_line: str | None = None
    drop_line: str | None = None
    strip: str | None = None
    yen_alias: str | None = None
    free: str | None = FREE_WORDS


POLICIES = {p.name: p for p in (
    PricePolicy("leading", leading=True),
    PricePolicy("tax_included", amount=YEN_TAX_INCLUDED, group=1, fallback=YEN_PREFIX),
    PricePolicy("zone", zone=r"(?s)(?:入\s*場|料金|チケット)(.{0,300})",
                cut=r"主催|問い合わせ|お問い合わせ|スケジュール|一覧|※|■"),
    PricePolicy("keyword_lines", amount=YEN_PREFIX, group=1, drop_line=r"^※",
                keep_line=r"(?i)ADV|DOOR|前売|当日|一般|料金|TICKET", free=None),
    PricePolicy("backslash_yen", yen_alias=r"\\(?=\s*[\d０-９])"),
    PricePolicy("bare_digits", zone=r"(?is)PRICE[\]】:：\s]*([^\n]*)",
                amount=r"(\d{1,3}(?:,\d{3})+|\d{3,5})", group=1),
    PricePolicy("headline", first_only=True),
)}


def price_by_policy(text: Column, policy: PricePolicy) -> Column:
    """``struct(price_text, price_min, is_free)`` under ``policy``."""
    zone = first_group(text, policy.zone) if policy.zone else text
    if policy.cut:
        zone = F.element_at(F.split(zone, policy.cut, 2), 1)
    if policy.yen_alias:
        zone = F.regexp_replace(zone, policy.yen_alias, "¥")
    return let(_price_lines(zone, policy), lambda lines: _read_lines(lines, policy))


def _price_lines(zone: Column, policy: PricePolicy) -> Column:
    lines = F.filter(F.transform(F.split(zone, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    if policy.keep_line:
        lines = F.filter(lines, lambda s: s.rlike(policy.keep_line))
    if policy.drop_line:
        lines = F.filter(lines, lambda s: ~s.rlike(policy.drop_line))
    if policy.strip:
        lines = F.transform(lines, lambda s: F.regexp_replace(s, policy.strip, ""))
    return lines


def _read_lines(lines: Column, policy: PricePolicy) -> Column:
    body = F.array_join(lines, " ")
    if policy.leading:
        found = F.filter(
            F.transform(lines, lambda s: to_amount(
                F.regexp_extract(s, policy.amount, policy.group))),
            lambda v: v.isNotNull())
    else:
        found = _amounts(all_groups(body, policy.amount, policy.group))
        if policy.fallback:
            other = _amounts(all_groups(body, policy.fallback, 1))
            found = F.when(F.size(found) > 0, found).otherwise(other)
    floor = F.try_element_at(found, F.lit(1)) if policy.first_only else F.array_min(found)
    shown = squeeze(body)

    def verdict(floor: Column) -> Column:
        out = F.when(floor.isNotNull(), price_struct(shown, floor, floor == 0))
        if policy.free:
            out = out.when(body.rlike(policy.free), price_struct(shown, F.lit(0), F.lit(True)))
        return out

    return let(floor, verdict)


def with_admission(rows: DataFrame, text: str, out: str = "admission") -> DataFrame:
    """Add the adult admission read from ``text``.  The width folding is a
    Python stage of its own, so it is a column before the reading starts."""
    folded = rows.withColumn("_flat", nfkc(F.coalesce(text, F.lit(""))))
    return folded.withColumn(out, admission(F.col("_flat"))).drop("_flat")


def admission(flat: Column) -> Column:
    """Adult admission of an exhibition page (width-folded text) as
    ``struct(price_text, price_min, is_free)``.

    Each label opens a 300-character window.  In it the amount next to the
    adult tier counts, the day-of block before any other; an unmistakable
    label may open with a bare amount.  The first window with a sane amount
    (100 to 30000) or an opening "free" decides; a free-entry phrase anywhere
    is the last resort.
    """
    opened = rf"(?s)({ADMISSION_LABEL})(?=(.{{0,300}}))"
    labels, windows = all_groups(flat, opened, 1), all_groups(flat, opened, 2)
    # group 2 is looked ahead, so a window may hold the next label too
    verdicts = F.transform(windows, lambda w, i: _window_verdict(w, labels[i]))
    decided = F.filter(verdicts, lambda v: v.isNotNull())
    best = F.try_element_at(decided, F.lit(1))
    free = price_struct(F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(True))
    return F.coalesce(best, F.when(flat.rlike(FREE_ADMISSION), free))


def _window_verdict(window: Column, label: Column) -> Column:
    day_of = F.instr(window, "当日")
    price = F.coalesce(
        F.when(day_of > 0, F.nullif(_adult(F.substring(window, day_of, F.lit(300))), F.lit(0))),
        _adult(window),
        F.when(label.rlike(STRICT_LABEL),
               to_amount(F.regexp_extract(F.substring(window, 1, 60), ANY_ADMISSION, 1))))
    free = price_struct(F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(True))

    def verdict(price: Column) -> Column:
        shown = F.concat(F.lit("一般 ¥"), F.format_number(price, 0))
        paid = price_struct(shown, price, F.lit(None).cast("boolean"))
        return F.when(price.between(100, 30000), paid) \
            .when(price.isNull() & window.rlike(rf"^[^0-9]{{0,15}}{FREE_WORDS}"), free)

    return let(price, verdict)


def _adult(segment: Column) -> Column:
    """Earliest adult amount, either printing order."""
    label_at = F.nullif(F.regexp_instr(segment, F.lit(ADULT_THEN_PRICE)), F.lit(0))
    price_at = F.nullif(F.regexp_instr(segment, F.lit(PRICE_THEN_ADULT)), F.lit(0))
    label_first = F.coalesce(label_at <= price_at, label_at.isNotNull())
    return to_amount(F.when(label_first, F.regexp_extract(segment, ADULT_THEN_PRICE, 1))
                     .otherwise(F.regexp_extract(segment, PRICE_THEN_ADULT, 1)))

"""Vocabulary flags, status tags and row-level classification of text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Announcement vocabulary.
SOLD_OUT = (r"(?iu)SOLD[\s-]*OUT|ソールドアウト|完売|"
            r"予定枚数[がはに]?終了(?:しました|いたしました|致しました)|満員御礼")
NON_MUSIC = (
    r"(?iu)ディズニー・?オン・?アイス|DISNEY\s*ON\s*ICE|アイスショー|ON\s*ICE\b|"
    r"フィギュアスケート|Bリーグ|B\.LEAGUE|SVリーグ|Tリーグ|Vリーグ|"
    r"大相撲|(?:新日本|全日本)プロレス|プロレスリング|"
    r"タイトルマッチ|世界戦|(?<![0-9A-Za-z])RIZIN|(?<![0-9A-Za-z])K-1(?![0-9A-Za-z])|"
    r"卓球|バレーボール|バスケットボール|ハンドボール|世界選手権|全日本選手権|"
    r"式典|入学式|卒業式|入社式|株主総会|表彰式|説明会|業界研究|"
    r"東京ガールズコレクション|ガールズアワード|GirlsAward|"
    r"舞台「|朗読劇|展示会|見本市|即売会")
MULTI_ACT = r"(?iu)TOUR|PRESENTS|FES(?:TIVAL)?|\sVS\.?\s|×|\sx\s|&|meets|produced\s+by"
#: tag -> words, in printing order of precedence for the first two
STATUS_WORDS = {
    "cancelled": r"中止",
    "postponed": r"延期",
    "streaming": r"配信",
    "2-stages": r"(?i)2nd\s*Stage",
    "dark-days": r"休演日",
}
STATUS_MARK = r"[【\[(（][^】\])）]*(?:中止|延期)[^】\])）]*[】\])）]"
SEATS_LEFT, SEATS_GONE = "◎○△", "×"
#: rows that are not a public event
NOT_AN_EVENT = r"(?iu)^\s*(?:coming soon|TBA|未定)|関係者|貸切|PRIVATE|メンテナンス|maintenance|休館日"


def is_sold_out(text: Column) -> Column:
    """Announced as sold out; seat-chart legends and "while stocks last"
    phrases are not announcements."""
    return text.rlike(SOLD_OUT)


def sold_out_by_seats(chart: Column) -> Column:
    """A seat chart shows only crosses."""
    return chart.contains(SEATS_GONE) & ~chart.rlike(f"[{SEATS_LEFT}]")


def is_non_music(text: Column) -> Column:
    return text.rlike(NON_MUSIC)


def status_tags(text: Column, words: Mapping[str, str] = STATUS_WORDS) -> Column:
    """Tags in vocabulary order; a cancelled row is not also postponed."""
    tags = []
    for tag, pattern in words.items():
        hit = text.rlike(pattern)
        if tag == "postponed" and "cancelled" in words:
            hit = hit & ~text.rlike(words["cancelled"])
        tags.append(F.when(hit, tag))
    return F.array_compact(F.array(*tags))


def without_status_mark(title: Column) -> Column:
    """Title without its bracketed status note; kept whole if only that."""
    bare = F.trim(F.regexp_replace(title, STATUS_MARK, ""))
    return F.when(bare != "", bare).otherwise(title)


def is_single_act(title: Column) -> Column:
    """The title carries no tour or multi-act marker."""
    return ~title.rlike(MULTI_ACT)


def title_as_lineup(title: Column) -> Column:
    """The title as a one-name line-up, only when it can be an act's name."""
    return F.when((F.coalesce(title, F.lit("")) != "") & is_single_act(title),
                  F.array(title)).otherwise(F.array().cast("array<string>"))


def classify_text(text: Column, site_tag: Column | None = None,
                  tag_categories: Mapping[str, str] | None = None,
                  rules: Sequence[tuple[str, str]] = (("other", NON_MUSIC),),
                  default: str = "music") -> Column:
    """Category by the site's own tag, then the first matching rule, then
    the default.  Rules are precision-first and can be extended per venue."""
    by_tag = F.lit(None).cast("string")
    if site_tag is not None and tag_categories:
        pairs = [F.lit(x) for item in tag_categories.items() for x in item]
        by_tag = F.create_map(*pairs)[site_tag]
    by_rule = [F.when(text.rlike(pattern), label) for label, pattern in rules]
    return F.coalesce(by_tag, *by_rule, F.lit(default))


def is_listable(title: Column, extra: str | None = None) -> Column:
    """A public event row: titled, and none of the placeholder, private,
    maintenance, industry-only or ``extra`` (other hall, other site) rows."""
    pattern = NOT_AN_EVENT if extra is None else f"{NOT_AN_EVENT}|{extra}"
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & ~title.rlike(pattern)

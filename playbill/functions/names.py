"""Titles, line-ups and artist names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.text import first_group, squeeze, strip_chars

# Role marks and placeholders in line-ups.
ROLE_PREFIX = r"(?iu)^(?:O\.?A\.?|ゲスト|GUEST|w/|with|feat\.?|FEAT\.?)[:：\s]+"
PLACEHOLDER = (r"(?iu)^(?:and\s+more|more|ほか|他|TBA|TBD|COMING\s+SOON|未定|調整中)"
               r"[.…!！]*$")
REPEATED = r"(?s)^(.{2,}?)\1+"
QUOTED = r"[「『“\"]([^」』”\"]{2,})[」』”\"]"


def split_repeated(head: Column) -> tuple[Column, Column]:
    """A block that prints its title twice or more before the rest:
    'XXY' gives ('X', 'Y')."""
    title = first_group(head, REPEATED)
    rest = F.nullif(strip_chars(F.regexp_replace(head, REPEATED, ""), " -–—|・"), F.lit(""))
    return (F.coalesce(F.trim(title), F.trim(head)),
            F.when(title.isNotNull(), rest))


def best_title(heading: Column, text: Column, marker: str) -> Column:
    """Heading, else the first quoted phrase, else the text before ``marker``."""
    before = F.nullif(squeeze(F.element_at(F.split(text, marker, 2), 1)), F.lit(""))
    return F.coalesce(F.nullif(squeeze(heading), F.lit("")), first_group(text, QUOTED), before)


@dataclass(frozen=True)
class LineupPolicy:
    """How one kind of site prints a bill.

    Lines that match ``skip_line`` are left out and ``line_prefix`` is cut off
    the others; lines are cut at ``separators`` (labels in ``section_label``
    count as such); ``inside`` is cut out of a name; with ``after_colon`` what
    follows the last colon of it counts; ``label_prefix`` is cut off and
    ``drop`` drops it.  ``longest`` and ``most`` limit names only where a site
    needs it.
    """

    separators: str = r"[/／\n]"
    section_label: str | None = None
    skip_line: str | None = None
    line_prefix: str | None = None
    inside: str | None = None
    after_colon: bool = False
    label_prefix: str = r"(?iu)^(?:special\s*guest|guest|ゲスト|opening\s*act|出演者?)\s*[:：]\s*"
    drop: str = r"(?iu)^[＜<][^＞>]*[＞>]$|^(?:TBA|TBD|COMING SOON|AND MORE|他|ほか|MC)$"
    longest: int | None = None
    most: int | None = None
    trim: str = " 　・,、"
    cut_urls: bool = True


# What the three layouts of a bill leave out and cut off.
CARD_BODY = LineupPolicy(
    skip_line=r"(?iu)OPEN|START|CLOSE|開場|開演|\d{1,2}[:：]\d{2}|～|SOLD\s*OUT|THANK\s*YOU|完売|予告なく|入場不可|詳細は後日|お楽しみ|未定|"
              r"貸し?切り|^※|^■|^●|^-|SUPPORT\s*ACT|and\s*more|FC限定",
    line_prefix=r"(?u)^\s*[【《\[＜(][^】》\]＞)]{0,14}[】》\]＞)]\s*", separators=r"[/／\n]", trim=" ・,、",
    after_colon=True, label_prefix="", drop="^$", longest=40, most=40, cut_urls=False)
LINES_ONLY = LineupPolicy(
    separators=r"\n", label_prefix=r"(?u)^出演者\s*[:：]\s*", trim=" 　・-‐–—", most=40, cut_urls=False,
    drop=r"(?iu)^http|^[-‐–—【\[]*\s*(?:ARTIST|ATHLETE|GUEST|CAST|ゲスト|出演者)\s*[-‐–—】\]:：]*$|順次|追って|後日|発表|決定|ご案内|ご確認")
HEADLINER = LineupPolicy(separators=r"[\n/／、,]", inside=r"【[^】]*】", label_prefix="", drop="^※", trim=" ", cut_urls=False)


def split_lineup(text: Column, policy: LineupPolicy = LineupPolicy()) -> Column:
    """Names in printed order, cleaned, without placeholders or repeats."""
    work = F.regexp_replace(text, r"https?://[^\s　]+", "\n") if policy.cut_urls else text
    if policy.section_label:
        work = F.regexp_replace(work, policy.section_label, "\n")
    if policy.skip_line or policy.line_prefix:
        lines = F.split(F.replace(work, F.lit("\u00a0"), F.lit(" ")), "\n")
        if policy.skip_line:
            lines = F.filter(lines, lambda x: ~F.trim(x).rlike(policy.skip_line))
        if policy.line_prefix:
            lines = F.transform(lines, lambda x: F.regexp_replace(x, policy.line_prefix, ""))
        work = F.array_join(lines, "\n")

    def clean(n: Column) -> Column:
        if policy.inside:
            n = F.regexp_replace(n, policy.inside, "")
        n = strip_chars(squeeze(n), policy.trim)
        if policy.after_colon:
            n = squeeze(F.regexp_replace(n, "(?s)^.*[:：]", ""))
        if policy.label_prefix:
            n = strip_chars(F.regexp_replace(n, policy.label_prefix, ""), policy.trim)
        return n

    names = F.transform(F.split(work, policy.separators), clean)
    names = F.filter(names, lambda n: (n != "") & ~n.rlike(policy.drop))
    if policy.longest is not None:
        names = F.filter(names, lambda n: F.length(n) <= policy.longest)
    names = F.array_distinct(names)
    return names if policy.most is None else F.slice(names, 1, policy.most)


def bare_entry(raw: Column) -> Column:
    """A line-up entry without the marks round it, its role still in front."""
    return strip_chars(squeeze(F.coalesce(raw, F.lit(""))), " 　・/／|,、")


def clean_artist(raw: Column) -> Column:
    """Display name of a line-up entry; null when it names nobody."""
    bare = F.trim(F.regexp_replace(bare_entry(raw), ROLE_PREFIX, ""))
    ok = F.length(bare).between(2, 80) & ~bare.rlike(PLACEHOLDER)
    return F.when(ok, bare)

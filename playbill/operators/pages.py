"""Pages to facts: text, links, blocks, labels, elements, tour legs.

Flat facts come from regular expressions in the JVM.  Where nesting matters,
``elements`` turns a page into a table of its elements (one small stdlib
parser per row, inside ``mapInArrow``) and the rest is joins over it.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill.functions.flags import is_sold_out
from playbill.functions.prices import price_floor, without_drink_charges
from playbill.functions.text import all_groups, first_group, let, squeeze
from playbill.functions.times import open_start
from playbill.functions.urls import absolute_url, code_links, is_generic_link, provider_of
from playbill.operators.ranking import carry_forward, first_per_key
from playbill.schema import LINKS
from playbill.session import cut_lineage

HIDDEN = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>"
TAG = r"(?s)<[A-Za-z/!?][^>]*>"
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'>\s]+)"""
HEADING = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
# Entities decoded without leaving the JVM.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'",
            "&apos;": "'", "&yen;": "¥", "&copy;": "©", "&middot;": "·", "&times;": "×",
            "&amp;": "&"}
ENTITY_LEFT = r"&(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);"


@F.pandas_udf(T.StringType())
def _unescape_udf(values: pd.Series) -> pd.Series:
    return values.map(html_lib.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Decode entities.  Text with none but the common ones stays in the JVM;
    only the rest reaches the Python worker."""
    rare = r"&(?!(?:nbsp|lt|gt|quot|#39|apos|yen|copy|middot|times|amp);)" + ENTITY_LEFT[1:]
    plain = text
    for name, char in ENTITIES.items():
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.coalesce(_unescape_udf(F.when(text.rlike(rare), text)), plain)


def visible_text(page: Column) -> Column:
    """What a reader sees: no scripts, styles, comments or tags, entities
    decoded, white space collapsed."""
    return squeeze(unescape(F.regexp_replace(F.regexp_replace(page, HIDDEN, " "), TAG, " ")))


def page_title(page: Column) -> Column:
    return F.nullif(visible_text(F.regexp_extract(page, TITLE, 1)), F.lit(""))


def headings(page: Column) -> Column:
    """Heading texts in order."""
    raw = all_groups(F.regexp_replace(page, HIDDEN, " "), HEADING, 2)
    return F.filter(F.transform(raw, lambda h: squeeze(F.regexp_replace(h, TAG, " "))),
                    lambda h: h != "")


def links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
          keep_href: str | None = None) -> DataFrame:
    """(page_id, pos, href, link_url, link_text): every link of every page
    with its absolute URL, optionally only those whose href matches."""
    body = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", " ")
    anchors = F.arrays_zip(all_groups(body, ANCHOR, 1).alias("attrs"),
                           all_groups(body, ANCHOR, 2).alias("inner"))
    rows = pages.select(page_id, F.col(url).alias("_page"), F.posexplode(anchors).alias("pos", "_a"))
    href = F.replace(first_group(F.col("_a.attrs"), HREF), F.lit("&amp;"), F.lit("&"))
    out = rows.select(page_id, "pos", "_page", href.alias("href"),
                      squeeze(F.regexp_replace("_a.inner", TAG, " ")).alias("link_text")) \
        .filter("href is not null")
    if keep_href is not None:
        out = out.filter(F.col("href").rlike(keep_href))
    return out.select(page_id, "pos", "href",
                      absolute_url(F.col("href"), F.col("_page")).alias("link_url"), "link_text")


def distinct_links(found: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Each target once per page, where it is printed first."""
    return first_per_key(found, [page_id, "link_url"], [F.col("pos")])


def ticket_links(found: DataFrame, text: DataFrame, page_id: str = "page_id") -> DataFrame:
    """(page_id, ticket_links): event links to known ticket sites in printed
    order, each once, then printed P and L codes.  ``text`` is
    (page_id, text).  The list is bounded by one page's distinct links."""
    record = F.struct(provider_of(F.col("link_url")).alias("provider"),
                      F.col("link_url").alias("url"), F.lit(None).cast("string").alias("code"))
    sold = found.filter(provider_of(F.col("link_url")).isNotNull()
                        & ~is_generic_link(F.col("link_url")))
    listed = distinct_links(sold, page_id).groupBy(page_id).agg(
        F.array_sort(F.collect_list(F.struct("pos", record.alias("link")))).alias("_l"))
    return text.join(listed, page_id, "left").select(page_id, F.concat(
        F.coalesce(F.transform("_l", lambda s: s["link"]), F.array().cast(LINKS)),
        code_links(F.col("text"))).alias("ticket_links"))


def blocks(pages: DataFrame, page_id: str, text: str, marker: str) -> DataFrame:
    """(page_id, pos, block): the page cut before every match of ``marker``;
    what precedes the first match is block 0."""
    cut = F.split(F.col(text), f"(?={marker})")
    return pages.select(page_id, F.posexplode(cut).alias("pos", "block"))


def carry_marker(rows: DataFrame, page_id: str, marker: Column, out: str = "marker") -> DataFrame:
    """Blocks take the value of the last marker block at or before them (a
    date card, then its event cards)."""
    marked = rows.withColumn("_m", marker)
    return carry_forward(marked, [page_id], [F.col("pos")], "_m", out).drop("_m")


def label_values(text: Column, labels: Sequence[str]) -> Column:
    """Map of printed label to the text up to the next label; the first
    occurrence of a label wins."""
    any_label = "|".join(labels)
    plain = not any(re.search(r"[^\w\s]", a) or (a in b and a != b) for a in labels for b in labels)
    if plain:
        # labels lie apart, so one cut before each of them tells all
        parts = F.filter(F.split(text, rf"[【\[（(]?(?=(?:{any_label}))"), lambda p: p.rlike(f"^(?:{any_label})"))
        read = F.transform(parts, lambda p: F.struct(
            F.regexp_extract(p, f"^(?:{any_label})", 0).alias("key"),
            squeeze(F.regexp_replace(p, rf"^(?:{any_label})[】\]）)]?\s*[:：]?\s*", "")).alias("value")))
        return let(read, lambda r: F.map_from_entries(F.filter(
            r, lambda e, i: F.array_position(r["key"], e["key"]) == i + 1)))
    pattern = rf"(?s)({any_label})[】\]）)]?\s*[:：]?\s*(.*?)(?=[【\[（(]?(?:{any_label})|$)"
    names, values = all_groups(text, pattern, 1), all_groups(text, pattern, 2)
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(
        n.alias("key"), squeeze(F.element_at(values, F.array_position(names, n).cast("int")))
        .alias("value"))))


# --- element table ----------------------------------------------------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
         "source", "track", "wbr"}
#: a cell or term ends where the next one of its table or list begins
_ENDED_BY = {"td": ({"td", "th"}, "table"), "th": ({"td", "th"}, "table"), "tr": ({"td", "th", "tr"}, "table"),
             "dt": ({"dt", "dd"}, "dl"), "dd": ({"dt", "dd"}, "dl")}
#: rows handed to Arrow at a time
ELEMENT_BATCH = 20_000
#: position and tag of the row that holds a page's text
PAGE, PAGE_TAG = -1, "#page"
#: most columns a cell spans, as in browsers
MOST_COLUMNS = 1000
ELEMENT_SCHEMA = ("pos int, tag string, attrs map<string,string>, parent int, until int, text_from int, text_to int, "
                  "cell struct<table_pos:int,row:int,col:int,rows:int,cols:int>, runs array<string>")


#: a page of plain tags, and its pieces; anything else is left to the parser
_NAME = r"(?!(?:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext|svg|math)\b)[a-z][a-z0-9]*"
_ATTRS = r"(?:[ \n]+[a-z][a-z0-9-]*=\"[^\"<>&]*\")*"
_PLAIN = re.compile(rf"(?:[^<&\0]++|<{_NAME}{_ATTRS}>|</{_NAME}>)*+")
_PIECE = re.compile(rf"([^<]+)|<([a-z][a-z0-9]*)({_ATTRS})>|</([a-z][a-z0-9]*)>")
_ATTR = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')


class _Grid:
    """Where the cells of one table fall: a cell takes the first column that
    no cell of an earlier row reaches down to."""

    def __init__(self, pos):
        self.pos, self.row, self.col, self.reach = pos, -1, 0, {}

    def next_row(self):
        self.row, self.col = self.row + 1, 0

    def place(self, attrs):
        def span(name, most):
            digits = (attrs.get(name) or "").strip()
            return min(int(digits), most) if digits.isascii() and digits.isdigit() else 1

        if self.row < 0:
            self.next_row()
        rows, cols = span("rowspan", 65_534), max(span("colspan", MOST_COLUMNS), 1)
        while self.reach.get(self.col, -1) >= self.row:
            self.col += 1
        at, self.col = self.col, self.col + cols
        # a span of 0 reaches to the end of the table
        last = self.row + rows - 1 if rows else 1 << 30
        for c in range(at, at + cols):
            self.reach[c] = max(self.reach.get(c, -1), last)
        return {"table_pos": self.pos, "row": self.row, "col": at, "rows": rows, "cols": cols}


class _Reader(HTMLParser):
    """Numbers elements in document order; ``until`` is the last element
    inside.  Text is kept once, as the page's runs; an element knows which of
    them lie inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.runs, self.grids = [], [], [], []

    @classmethod
    def read(cls, page: str) -> list[tuple]:
        reader = cls()
        if _PLAIN.fullmatch(page):
            for text, start, attrs, end in _PIECE.findall(page):
                if text:
                    reader.handle_data(text)
                elif start:
                    reader.handle_starttag(start, _ATTR.findall(attrs) if attrs else [])
                else:
                    reader.handle_endtag(end)
        else:
            reader.feed(page)
            reader.close()
        last, end = len(reader.rows) - 1, len(reader.runs)
        out = [(PAGE, PAGE_TAG, [], None, last, 0, end, None, reader.runs)]
        for i, (tag, attrs, parent, until, start, stop, cell) in enumerate(reader.rows):
            if until is None:
                until, stop = (i, start) if tag in _VOID else (last, end)
            out.append((i, tag, list(attrs.items()), parent, until, start, stop, cell, None))
        return out

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        ended, within = _ENDED_BY.get(tag, ((), None))
        at = None
        for i in reversed(self.open if ended else ()):
            if self.rows[i][0] == within:
                break
            at = i if self.rows[i][0] in ended else at
        if at is not None:
            self._close(at)
        parent, cell = self.open[-1] if self.open else None, None
        if tag == "table":
            self.grids.append(_Grid(len(self.rows)))
        elif tag == "tr" and self.grids:
            self.grids[-1].next_row()
        elif tag in ("td", "th") and self.grids:
            cell = self.grids[-1].place(attrs)
        self.rows.append([tag, attrs, parent, None, len(self.runs), None, cell])
        if tag not in _VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        at = next((i for i in reversed(self.open) if self.rows[i][0] == tag), None)
        if at is not None:
            self._close(at)

    def _close(self, at):
        """Everything open from element ``at`` on ends here."""
        while self.open and self.open[-1] >= at:
            row = self.rows[self.open.pop()]
            row[3], row[5] = len(self.rows) - 1, len(self.runs)
            if row[0] == "table":
                self.grids.pop()

    def handle_data(self, data):
        if data.strip() and not (self.open and self.rows[self.open[-1]][0] in ("script", "style")):
            self.runs.append(data.strip())


_ELEMENT_TYPES = {
    "pos": pa.int32(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "parent": pa.int32(), "until": pa.int32(),
    "text_from": pa.int32(), "text_to": pa.int32(),
    "cell": pa.struct([(n, pa.int32()) for n in ("table_pos", "row", "col", "rows", "cols")]), "runs": pa.list_(pa.string())}


def _columns(idents: pa.Array, counts: list[int], rows: list[tuple]) -> pa.RecordBatch:
    """Element rows of consecutive pages, the i-th with ``counts[i]`` rows."""
    ident = idents.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
    cols = [pa.array(col, kind) for col, kind in zip(zip(*rows), _ELEMENT_TYPES.values())]
    return pa.RecordBatch.from_arrays([ident, *cols], names=["id", *_ELEMENT_TYPES])


def elements(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per element: (page_id, pos, tag, attrs, parent, until) with the
    range of text runs inside it and, for a cell, its place in its table; and
    one row per page, at PAGE, with the runs themselves."""
    key = pages.schema[page_id].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents, first, counts, rows = batch.column(0), 0, [], []
            for source in batch.column(1).to_pylist():
                found = _Reader.read(source or "")
                rows += found
                counts.append(len(found))
                if len(rows) > ELEMENT_BATCH:
                    yield _columns(idents.slice(first, len(counts)), counts, rows)
                    first, counts, rows = first + len(counts), [], []
            if rows:
                yield _columns(idents.slice(first, len(counts)), counts, rows)

    return pages.select(page_id, html).mapInArrow(read, f"id {key}, {ELEMENT_SCHEMA}") \
        .withColumnRenamed("id", page_id)


def inner_text(table: DataFrame, wanted: DataFrame, page_id: str = "page_id", name: str = "text") -> DataFrame:
    """``wanted`` (page_id, text_from, text_to, ...) with the text of each
    element: its runs in order, white space collapsed."""
    runs = table.filter(F.col("pos") == PAGE).select(page_id, "runs")
    inside = F.slice("runs", F.col("text_from") + 1, F.col("text_to") - F.col("text_from"))
    return wanted.join(runs, page_id).withColumn(name, squeeze(F.array_join(inside, " "))).drop("runs")


def modal_links(table: DataFrame, page_id: str = "page_id", button: str = "data-modal-target",
                modal: str = "data-modal-id") -> DataFrame:
    """(page_id, target, href, link_text): links inside the element that a
    button names, for sites whose buttons carry an id instead of a URL.
    ``table`` is read four times, so it is stored once here."""
    table = cut_lineage(table)
    buttons = table.select(page_id, F.col("attrs")[button].alias("target")) \
        .filter("target is not null and target <> ''").distinct()
    modals = first_per_key(
        table.select(page_id, F.col("attrs")[modal].alias("target"), "pos", "until")
        .filter("target is not null"), [page_id, "target"], [F.col("pos")])
    anchors = table.filter("tag = 'a'").select(
        page_id, F.col("pos").alias("a_pos"), F.col("attrs")["href"].alias("href"), "text_from", "text_to").filter("href is not null")
    inside = buttons.join(modals, [page_id, "target"]).join(anchors, page_id) \
        .filter(F.col("a_pos").between(F.col("pos"), F.col("until")))
    return inner_text(table, inside, page_id, "link_text") \
        .groupBy(page_id, "target", "href").agg(F.min_by("link_text", "a_pos").alias("link_text"))


def ancestors(table: DataFrame, start: DataFrame, hops: int, page_id: str = "page_id") -> DataFrame:
    """(page_id, pos, hop, node, text_from, text_to): the elements met when
    climbing from ``start`` (page_id, pos), itself at hop 0, level by level."""
    index = table.filter(F.col("pos") != PAGE).select(
        page_id, F.col("pos").alias("node"), F.col("parent").alias("_up"), "text_from", "text_to")
    level = start.select(page_id, "pos", F.col("pos").alias("node"))
    out = None
    for hop in range(hops):
        met = level.join(index, [page_id, "node"]).withColumn("hop", F.lit(hop))
        out = met if out is None else out.unionByName(met)
        level = met.filter("_up is not null").select(page_id, "pos", F.col("_up").alias("node"))
    return out.drop("_up")


def enclosing_blocks(table: DataFrame, start: DataFrame, marker: str, longer_than: int = 30, hops: int = 5,
                     page_id: str = "page_id") -> DataFrame:
    """(page_id, pos, node, text): for each element of ``start`` (page_id,
    pos) the smallest element round it whose text matches ``marker`` and has
    more than ``longer_than`` characters, at most ``hops - 1`` levels up.
    Elements without one are left out.  ``table`` is read once per level, so
    it should be a stored one."""
    met = ancestors(table, start, hops, page_id)
    # elements that enclose several links are read once
    nodes = inner_text(table, met.select(page_id, "node", "text_from", "text_to").distinct(), page_id)
    fit = nodes.filter(F.col("text").rlike(marker) & (F.length("text") > longer_than)).select(page_id, "node", "text")
    return met.join(fit, [page_id, "node"]).groupBy(page_id, "pos").agg(
        F.min_by(F.struct("node", "text"), "hop").alias("_b")).select(page_id, "pos", "_b.*")


def table_columns(table: DataFrame, page_id: str = "page_id", tag: str = "td") -> DataFrame:
    """(page_id, row, col, text): cells with their column position."""
    cells = table.filter(F.col("tag") == tag).select(page_id, F.col("parent").alias("row"), "pos", "text_from", "text_to")
    place = cells.groupBy(page_id, "row").agg(F.array_sort(F.collect_list("pos")).alias("_at"))
    cells = inner_text(table, cells, page_id)
    return cells.join(place, [page_id, "row"]).select(
        page_id, "row", (F.array_position("_at", F.col("pos")) - 1).cast("int").alias("col"), "text")


def table_grid(table: DataFrame, page_id: str = "page_id") -> DataFrame:
    """(page_id, table_pos, row, col, pos, tag, text): every square of every
    table's grid with the cell that covers it; a cell that spans rows or
    columns covers several.  Spans end with the table's last row."""
    cells = table.filter(F.col("cell").isNotNull()).select(page_id, "pos", "tag", "text_from", "text_to", "cell.*")
    last = cells.groupBy(page_id, "table_pos").agg(F.max("row").alias("_last"))
    cells = inner_text(table, cells, page_id).join(last, [page_id, "table_pos"])
    end = F.when(F.col("rows") == 0, F.col("_last")).otherwise(F.least(F.col("row") + F.col("rows") - 1, F.col("_last")))
    rows = F.explode(F.sequence("row", end)).alias("row")
    cells = cells.select(page_id, "table_pos", rows, "col", "cols", "pos", "tag", "text")
    return cells.select(page_id, "table_pos", "row",
                        F.explode(F.sequence(F.col("col"), F.col("col") + F.col("cols") - 1)).alias("col"), "pos", "tag", "text")


def structured_labels(table: DataFrame, page_id: str = "page_id") -> DataFrame:
    """(page_id, kind, scope, pos, label, value): what a page's structure says
    belongs together.

    ``column``  a td and the header of its column: the last row of only th
                above it that covers the column
    ``row``     a td and the th before it in its row
    ``list``    a dd and the dt before it

    ``scope`` is the row's first cell, or the list; ``pos`` the value's
    element.  Values keep their place, so that "first wins" is a choice of the
    reader (``first_values``)."""
    grid = table_grid(table, page_id)
    row = Window.partitionBy(page_id, "table_pos", "row")
    grid = grid.withColumn("_heads", F.min(F.col("tag") == "th").over(row)) \
        .withColumn("scope", F.min("pos").over(row))
    upward = Window.partitionBy(page_id, "table_pos", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    sideward = row.orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_above", F.last(F.when(F.col("_heads"), F.col("text")), ignorenulls=True).over(upward)) \
        .withColumn("_beside", F.last(F.when((F.col("tag") == "th") & ~F.col("_heads"), F.col("text")), ignorenulls=True).over(sideward))
    values = grid.filter("tag = 'td'")
    columns, rows = (values.select(page_id, F.lit(kind).alias("kind"), "scope", "pos", F.col(c).alias("label"), F.col("text").alias("value"))
                     for kind, c in (("column", "_above"), ("row", "_beside")))
    # a cell that covers several columns of a row is one value of its row
    rows = rows.dropDuplicates([page_id, "scope", "pos"])
    terms = inner_text(table, table.filter(F.col("tag").isin("dt", "dd")).select(
        page_id, F.col("parent").alias("scope"), "pos", "tag", "text_from", "text_to"), page_id)
    before = Window.partitionBy(page_id, "scope").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    listed = terms.withColumn("label", F.last(F.when(F.col("tag") == "dt", F.col("text")), ignorenulls=True).over(before)) \
        .filter("tag = 'dd'").select(page_id, F.lit("list").alias("kind"), "scope", "pos", "label", F.col("text").alias("value"))
    return columns.unionByName(rows).unionByName(listed).filter("label <> ''")


def first_values(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, labels): map of label to its first value."""
    once = found.groupBy(*keys, "label").agg(F.min_by("value", "pos").alias("value"))
    return once.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("labels"))


# --- tour pages -------------------------------------------------------------

LEG_HEAD = r"20\d{2}/\d{1,2}/\d{1,2}"
LEG_LABELS = ("会場", "時間", "料金", "ゲスト", "備考")


def tour_legs(pages: DataFrame, page_id: str, text: str,
              labels: Sequence[str] = LEG_LABELS) -> DataFrame:
    """One row per leg of a tour page: the header cell gives date, prefecture
    and venue; labelled rows give times, prices and guests."""
    legs = blocks(pages, page_id, text, LEG_HEAD).filter(F.col("block").rlike(f"^{LEG_HEAD}"))
    fields = let(label_values(F.col("block"), labels), lambda m: F.struct(
        *[F.coalesce(m[label], F.lit("")).alias(n)
          for n, label in zip(("venue", "times", "price", "guests"), labels)]))
    # a generator is a barrier: the labels are read once per leg
    rows = legs.withColumn("_f", F.explode(F.array(fields)))
    opening, start = open_start(F.col("_f.times"), pair_first=True)
    price = price_floor(without_drink_charges(F.col("_f.price")))
    return rows.select(
        page_id, F.col("pos").alias("leg"),
        F.try_to_date(F.regexp_extract("block", LEG_HEAD, 0), "y/M/d").alias("start_date"),
        first_group(F.col("block"), rf"^{LEG_HEAD}\s*[(（]?[^)）\s]*[)）]?\s*[【\[]([^】\]]+)[】\]]").alias("pref"),
        F.nullif("_f.venue", F.lit("")).alias("venue_name"),
        opening.alias("open_time"), start.alias("start_time"),
        price["price_min"].alias("price_min"),
        is_sold_out(F.col("block")).alias("is_sold_out"),
        F.filter(F.split("_f.guests", r"[/／、]"),
                 lambda g: F.trim(g) != "").alias("guests"))


def matching_leg(events: DataFrame, sections: DataFrame, page_id: str) -> DataFrame:
    """The section of an event's page that names its date or venue, else the
    first one.  ``sections`` is (page_id, pos, block)."""
    d = F.col("start_date")
    padded, short = F.date_format(d, "yyyy/MM/dd"), F.date_format(d, "yyyy/M/d")
    venue = squeeze(F.coalesce("venue_name", F.lit("")))
    joined = events.join(sections, page_id, "left")
    def day(text):  # not the beginning of a later day
        return F.regexp_like("block", F.concat(text, F.lit(r"(?!\d)")))

    named = F.coalesce(day(padded) | day(short), F.lit(False)) \
        | F.coalesce((venue != "") & F.contains("block", venue), F.lit(False))
    return first_per_key(joined.withColumn("_miss", ~named), ["id"],
                         [F.col("_miss"), F.col("pos")]).drop("_miss")

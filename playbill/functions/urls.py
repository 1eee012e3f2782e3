"""URLs: absolute form, providers, and links that name no event."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.text import first_group, let

# Ticket sites, their generic pages, printed codes, host parts
# that never name a provider.
TICKET_PROVIDERS = {
    "eplus.jp": "eplus",
    "t.pia.jp": "pia",
    "w.pia.jp": "pia",
    "l-tike.com": "lawson",
    "ticket.rakuten": "rakuten",
    "zaiko.io": "zaiko",
    "t.livepocket.jp": "livepocket",
    "tiget.net": "tiget",
    "ticketmaster.co.jp": "ticketmaster",
}
P_CODE = r"(?U)[PＰ]コード[:：\s]*([\d-]{4,10})"
L_CODE = r"(?U)[LＬ]コード[:：\s]*([\d-]{4,10})"
HELP_HOST = r"(?i)^(?:support|faq|info|help)\."
SECTION_ROOTS = ("t", "sf", "interpia")
CHROME_SECTIONS = ("info", "premium", "guide", "help", "faq", "inquiry", "qa", "contact")
LEGACY_HOME = ("sys/main.jsp",)
HOST_SKIP = ("www", "info", "ticket", "tickets")
TLD_SKIP = ("co", "or", "ne", "ac", "go", "ad", "ed", "gr", "lg",
            "com", "net", "org", "jp", "io")


def absolute_url(href: Column, page_url: Column) -> Column:
    """``href`` seen from ``page_url``: absolute, scheme-relative,
    root-relative, query-only and path-relative forms."""
    return let(F.struct(href.alias("href"), page_url.alias("page")),
               lambda u: _absolute(u["href"], u["page"]))


def _absolute(href: Column, page_url: Column) -> Column:
    scheme = first_group(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)")
    root = first_group(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)")
    page = F.regexp_extract(page_url, r"^([^?#]*)", 1)
    folder = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(root, href))
            .when(href.rlike(r"^[?#]"), F.concat(page, href))
            .otherwise(F.concat(folder, F.regexp_replace(href, r"^(?:\./)+", ""))))


def host_of(url: Column) -> Column:
    return F.lower(first_group(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return first_group(url, r"^[^?#]*\?([^#]*)")


def provider_of(url: Column, providers: Mapping[str, str] = TICKET_PROVIDERS) -> Column:
    """Provider of the first domain, in table order, that the URL contains."""
    return let(url, lambda u: F.coalesce(*[F.when(u.contains(d), p) for d, p in providers.items()]))


def is_generic_link(url: Column) -> Column:
    """Points at the ticket site itself: help hosts, bare home pages, section
    roots and site chrome.  A short path is an artist's page and is kept."""
    def test(u: Column) -> Column:
        path, bare = u["path"], u["query"].isNull()
        return (F.coalesce(u["host"].rlike(HELP_HOST), F.lit(False))
                | ((path == "") & bare)
                | path.isin(*LEGACY_HOME)
                | F.split(path, "/")[0].isin(*CHROME_SECTIONS)
                | (path.isin(*SECTION_ROOTS) & bare))

    return let(let(url, lambda u: F.struct(
        host_of(u).alias("host"), query_of(u).alias("query"),
        F.lower(F.trim(path_of(u), F.lit("/"))).alias("path"))), test)


def provider_slug(url: Column, providers: Mapping[str, str] = TICKET_PROVIDERS) -> Column:
    """Known provider, else the host label that names the site, else the
    first host label left, else ``vendor``."""
    host = F.element_at(F.split(F.coalesce(
        first_group(url, r"https?://([^/]+)"), url), ":"), 1)
    parts = F.filter(F.split(host, r"\."), lambda p: ~p.isin(*HOST_SKIP))
    label = let(parts, lambda ps: F.coalesce(
        F.try_element_at(F.filter(ps, lambda p: ~p.isin(*TLD_SKIP)), F.lit(-1)),
        F.try_element_at(ps, F.lit(1))))
    return F.coalesce(provider_of(url, providers), label, F.lit("vendor"))


def code_links(text: Column) -> Column:
    """Printed P and L codes as link records."""
    def record(provider: str, letter: str, pattern: str) -> Column:
        code = first_group(text, pattern)
        return F.when(code.isNotNull(), F.struct(
            F.lit(provider).alias("provider"), F.lit(None).cast("string").alias("url"),
            F.concat(F.lit(letter), code).alias("code")))
    return F.array_compact(F.array(record("pia", "P", P_CODE), record("lawson", "L", L_CODE)))

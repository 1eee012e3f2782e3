"""Unicode folding and match keys.

Spark has no NFKC or casefold, so one Arrow UDF supplies them.  ASCII
strings never need it: they are folded by ``lower`` in the JVM and reach the
Python worker as nulls.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NON_ASCII = r"[^\x00-\x7f]"


@F.pandas_udf(T.StringType())
def _nfkc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(),
                      na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_names_udf(values: pd.Series) -> pd.Series:
    return values.map(
        lambda names: None if names is None else [
            None if n is None else unicodedata.normalize("NFKC", n).casefold()
            for n in names])


def _only_non_ascii(col: Column) -> Column:
    return F.when(col.rlike(_NON_ASCII), col)


def nfkc(col: Column) -> Column:
    """NFKC-normalised text."""
    return F.coalesce(_nfkc_udf(_only_non_ascii(col)), col)


def fold(col: Column) -> Column:
    """NFKC + casefold."""
    return F.coalesce(_fold_udf(_only_non_ascii(col)), F.lower(col))


def fold_names(col: Column) -> Column:
    """``fold`` over every element of an array of names."""
    mixed = F.exists(col, lambda n: F.coalesce(n.rlike(_NON_ASCII), F.lit(False)))
    return F.coalesce(_fold_names_udf(F.when(mixed, col)), F.transform(col, F.lower))


def squeeze(col: Column) -> Column:
    """Collapse runs of any Unicode white space and trim."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def no_space(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\s+", "")


def strip_chars(col: Column, chars: str) -> Column:
    """Trim any of ``chars`` from both ends."""
    return F.trim(col, F.lit(chars))


def name_key(col: Column) -> Column:
    """Identity key of a name: width and case folded, spaces collapsed."""
    return squeeze(fold(F.coalesce(col, F.lit(""))))


def name_keys(col: Column) -> Column:
    return F.transform(fold_names(col), lambda n: squeeze(F.coalesce(n, F.lit(""))))


def venue_norm(col: Column) -> Column:
    """Venue key: width and case folded, curly quotes straightened,
    bracketed notes and all white space dropped."""
    folded = F.translate(fold(F.coalesce(col, F.lit(""))), "’‘“”", "''\"\"")
    return no_space(F.regexp_replace(folded, r"\([^()]*\)", ""))


# Characters two spellings of one title disagree on.
_TILDE_FROM, _TILDE_TO = "〜", "~"
_DECORATION = "・®™©“”‘’\"'「」『』"


def _loosen(key: Column) -> Column:
    no_notes = F.regexp_replace(key, r"\([^()]*\)", "")
    return no_space(F.translate(no_notes, _TILDE_FROM + _DECORATION, _TILDE_TO))


def match_key(col: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Key for overlap tests only: alias spelling, folded, without notes,
    decoration or spaces.  ``aliases`` maps name keys to display names and is
    meant for a small curated table; larger ones join (``spell_canonically``)."""
    key = name_key(col)
    if aliases:
        key = F.coalesce(_alias_map(aliases)[key], key)
    return _loosen(key)


def match_keys(col: Column, aliases: Mapping[str, str] | None = None) -> Column:
    keys = name_keys(col)
    if aliases:
        table = _alias_map(aliases)
        keys = F.transform(keys, lambda k: F.coalesce(table[k], k))
    return F.transform(keys, _loosen)


def _alias_map(aliases: Mapping[str, str]) -> Column:
    pairs = []
    for alias, display in aliases.items():
        folded = " ".join(unicodedata.normalize("NFKC", display).split()).casefold()
        pairs += [F.lit(alias), F.lit(folded)]
    return F.create_map(*pairs)


def has_cjk(col: Column) -> Column:
    """Contains kana or an ideograph."""
    return col.rlike("[぀-ヿ㐀-鿿]")


def needle_floor(col: Column) -> Column:
    """Shortest text worth searching for: 3 characters with kana or
    ideographs, 4 without."""
    return F.when(has_cjk(col), 3).otherwise(4)


def mostly_ascii(col: Column) -> Column:
    """At least 70 % of the non-space characters are ASCII (true when none)."""
    dense = no_space(col)
    other = F.length(F.regexp_replace(dense, r"[\x00-\x7f]", ""))
    return (F.length(dense) - other) * 10 >= F.length(dense) * 7


def escape_regex(col: Column) -> Column:
    return F.regexp_replace(col, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use``
    reads it: expression trees are copied, so a large shared part would
    otherwise be compiled and run once per mention."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def first_group(col: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, null instead of empty."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def all_groups(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))

"""The event row, its vocabularies and the derived tables' schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Closed vocabularies of the data model.
CATEGORIES = ("music", "art", "festival", "music_festival",
              "fireworks", "flowers", "food", "other")
STATUSES = ("pending", "approved", "rejected", "auto")
PUBLIC_STATUSES = ("approved", "auto")
MUSIC_CATEGORIES = ("music", "music_festival")
GENRES = ("idol", "j-rock", "international", "k-pop", "jazz-soul",
          "classical", "hiphop-rnb", "electronic", "anime-seiyu")
ART_GENRES = ("contemporary", "photography", "design", "craft",
              "manga-anime", "nihonga-classical", "western-art")
SEASONAL_GENRES = ("matsuri", "hanabi", "flowers")
# Fields a listing observation must not wipe (merge), and
# fields a served row does not carry (feed).
REFILL_FIELDS = ("open_time", "start_time", "price_text", "price_min",
                 "is_free", "ticket_url", "ticket_links")
UNSERVED_FIELDS = ("price_text", "id", "status", "ticket_url", "lat", "lng", "tags")

LINK = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("code", T.StringType()),
])
LINKS = T.ArrayType(LINK)
NAMES = T.ArrayType(T.StringType())


_TYPES = {"string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(),
          "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(),
          "timestamp": T.TimestampType(), "array<string>": NAMES}


def _fields(spec: str) -> list[T.StructField]:
    """Nullable fields of ``name type, ...``; unlike a DDL parse this needs
    no running session at import."""
    pairs = [part.split() for part in spec.split(",")]
    return [T.StructField(name, _TYPES[kind]) for name, kind in pairs]


EVENT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("source_url", T.StringType(), False),
    *_fields("title_ja string, title_en string, subtitle string, category string"),
    T.StructField("genres", NAMES),
    *_fields("start_date date, end_date date, open_time string, start_time string, "
             "venue_name string, venue_area string, address string, lat double, "
             "lng double, price_text string, price_min int, is_free boolean"),
    T.StructField("is_sold_out", T.BooleanType(), False),
    T.StructField("ticket_url", T.StringType()),
    T.StructField("ticket_links", LINKS),
    T.StructField("lineup", NAMES),
    T.StructField("tags", NAMES),
])
EVENT_FIELDS = tuple(EVENT_SCHEMA.fieldNames())

STAGED_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    *EVENT_SCHEMA.fields,
    *_fields("content_hash string, status string, first_seen timestamp, "
             "last_seen timestamp, updated_at timestamp"),
])

RUN_SCHEMA = T.StructType(_fields(
    "run_id bigint, source string, started_at timestamp, finished_at timestamp, "
    "found bigint, new bigint, changed bigint, details_fetched bigint, error string, "
    "skipped_venues bigint"))


def conform(df: DataFrame, schema: T.StructType = EVENT_SCHEMA,
            extra: Sequence[str] = ()) -> DataFrame:
    """Shape ``df`` to ``schema``: unknown columns but ``extra`` dropped,
    missing ones added (empty list for arrays, ``other`` for category, false
    for the sold-out flag, null else)."""
    have = set(df.columns)
    return df.select(*extra, *[
        _default(f, F.col(f.name).cast(f.dataType) if f.name in have else None)
        for f in schema.fields])


def _default(field: T.StructField, value: Column | None) -> Column:
    if isinstance(field.dataType, T.ArrayType):
        fallback = F.array().cast(field.dataType)
    elif field.name == "category":
        fallback = F.lit("other")
    elif field.name == "is_sold_out":
        fallback = F.lit(False)
    else:
        fallback = F.lit(None).cast(field.dataType)
    out = fallback if value is None else F.coalesce(value, fallback)
    return out.alias(field.name)


def is_category(col: Column) -> Column:
    return col.isin(*CATEGORIES)


def is_blank(name: str, schema: T.StructType = EVENT_SCHEMA) -> Column:
    """Null, or an empty list; ``0`` and ``false`` are values."""
    col = F.col(name)
    if isinstance(schema[name].dataType, T.ArrayType):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull()

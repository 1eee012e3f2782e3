"""JSON feeds with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill.functions.text import let

_ERROR = "_unreadable"


def parse_feed(payloads: DataFrame, column: str, schema: T.DataType | str,
               rows: str | None = None, strict: bool = False) -> DataFrame:
    """Rows of a feed payload as column ``row``.

    A malformed payload yields no rows; with ``strict`` it fails the job, for
    feeds whose envelope must not change silently.  ``rows`` names the array
    inside the envelope; without it the payload is the row (or array of rows).
    Entries that are not objects come out as null and are skipped.
    """
    out = payloads.withColumn("_doc", _parsed(F.col(column), schema))
    body = F.col("_doc") if rows is None else F.col("_doc").getField(rows)
    if strict:
        body = F.when(body.isNull(), F.raise_error(F.concat(
            F.lit("feed envelope changed: "), F.substring(column, 1, 80)))).otherwise(body)
    out = out.withColumn("_body", body).drop("_doc")
    is_list = isinstance(out.schema["_body"].dataType, T.ArrayType)
    if is_list:
        out = out.withColumn("row", F.explode("_body"))
    else:
        out = out.withColumnRenamed("_body", "row")
    return out.drop("_body").filter(F.col("row").isNotNull())


def _parsed(text: Column, schema: T.DataType | str) -> Column:
    """The parsed value, null when the text does not fit the schema: parsing
    itself would give an object of nulls, so the reader's error column tells."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not isinstance(kind, T.StructType):
        return F.from_json(text, kind)
    marked = T.StructType([*kind.fields, T.StructField(_ERROR, T.StringType())])
    return let(F.from_json(text, marked, {"columnNameOfCorruptRecord": _ERROR}),
               lambda v: F.when(v[_ERROR].isNull(), v))


def malformed(payloads: DataFrame, column: str, schema: T.DataType | str) -> DataFrame:
    """Number of payloads that do not parse, for an alarm before a run."""
    bad = F.col(column).isNotNull() & _parsed(F.col(column), schema).isNull()
    return payloads.agg(F.count_if(bad).alias("malformed"))


def localised(entries: Column, culture: str, value: str = "value",
              key: str = "culture") -> Column:
    """Value for a culture out of an array of localisations, else the first
    entry's."""
    mine = F.filter(entries, lambda e: e[key] == culture)
    return F.coalesce(F.try_element_at(mine, F.lit(1))[value],
                      F.try_element_at(entries, F.lit(1))[value])


def first_headline(artists: Column, name: str = "name", flag: str = "headline") -> Column:
    """Name of the first entry flagged as headline, else of the first."""
    top = F.filter(artists, lambda a: F.coalesce(a[flag], F.lit(False)))
    return F.coalesce(F.try_element_at(top, F.lit(1))[name],
                      F.try_element_at(artists, F.lit(1))[name])


def any_status(statuses: Column, wanted: str, field: str = "status") -> Column:
    """Any nested entry has the status, case aside."""
    return F.coalesce(F.exists(statuses, lambda s: F.lower(s[field]) == wanted.lower()),
                      F.lit(False))

"""Event rows for tests: only the fields a test names."""

from datetime import date

from pyspark.sql import functions as F

from playbill.schema import EVENT_SCHEMA


def event(**given):
    base = {f.name: None for f in EVENT_SCHEMA.fields}
    base.update(category="music", genres=[], ticket_links=[], lineup=[], tags=[], is_sold_out=False)
    for f in ("start_date", "end_date"):
        if isinstance(given.get(f), str):
            given[f] = date.fromisoformat(given[f])
    assert set(given) <= set(base), set(given) - set(base)
    return tuple({**base, **given}[f.name] for f in EVENT_SCHEMA.fields)


def events(spark, *rows):
    return spark.createDataFrame([event(**r) for r in rows], EVENT_SCHEMA)


def numbered(spark, *rows, keys=None):
    """Events with id, ord and venue_key, in the given order."""
    df = events(spark, *[{k: v for k, v in r.items() if k not in ("id", "venue_key")} for r in rows])
    extra = spark.createDataFrame(
        [(r.get("id", str(n)), n, r.get("venue_key"), r["source_url"]) for n, r in enumerate(rows)],
        "id string, ord int, venue_key string, source_url string")
    return df.join(extra, "source_url")


def value(spark, expr, **cols):
    """One expression over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr).first()[0]


def values(spark, fn, texts):
    """``fn`` over a column of texts, in order."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[1] for r in sorted(rows.select("i", fn(F.col("text"))).collect())]

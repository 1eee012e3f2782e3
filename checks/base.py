"""Query registry, table access, and the stand-in event listing.

The given tables hold no event listings, so ``listing`` derives one from
``orders`` and ``part``: an order is an event, its status the kind of source,
its part the title and the acts.  It grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.operators.identity import content_hash, stable_id
from playbill.schema import conform
from playbill.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}



def as_of():
    return F.lit("1998-06-01").cast("date")


def now():
    return F.lit("1998-06-01 03:00:00").cast("timestamp")


PROMOTERS = ("promo_f", "promo_p")


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table about to be read character by character."""
    return spread(table(spark, sf, name))


def text(col: str) -> str:
    """A date or timestamp as text, so both engines print it alike."""
    return f"cast({col} as string)"


LISTING_COLUMNS = {
    "k": "o_orderkey",
    "source": "case o_orderstatus when 'F' then 'promo_f' when 'P' then 'promo_p' "
              "else concat('hall_', substring(o_orderpriority, 1, 1)) end",
    "title_ja": "concat(p_name, ' ', p_type)",
    "title_en": "case when o_orderkey % 4 = 0 then upper(p_name) end",
    "category": "case o_orderkey % 7 when 0 then 'other' when 1 then 'art' "
                "when 2 then 'music_festival' else 'music' end",
    "start_date": "cast(o_orderdate as date)",
    "open_time": "case when o_orderkey % 3 <> 0 "
                 "then concat(cast(15 + o_orderkey % 6 as {string}), ':30') end",
    "start_time": "case when o_orderkey % 3 <> 0 "
                  "then concat(cast(16 + o_orderkey % 6 as {string}), ':00') end",
    "venue_name": "concat('Hall ', substring(o_orderpriority, 1, 1))",
    "price_min": "case when o_orderkey % 6 <> 0 then cast(round(o_totalprice) as int) end",
    "is_free": "case when o_orderkey % 12 = 0 then true end",
    "is_sold_out": "o_orderkey % 9 = 0",
}


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows (plus ``id`` and ``k``) derived from orders and part."""
    joined = texts(spark, sf, "orders").join(
        table(spark, sf, "part"), F.col("o_custkey") == F.col("p_partkey"))
    cols = {n: F.expr(e.format(string="string")) for n, e in LISTING_COLUMNS.items()}
    k = F.col("o_orderkey")
    rows = joined.select(
        *[c.alias(n) for n, c in cols.items()],
        F.when(k % 5 == 0, F.date_add(cols["start_date"], (k % 4 + 1).cast("int"))).alias("end_date"),
        F.when(k % 5 == 0, F.array(F.struct(
            F.lit("eplus").alias("provider"),
            F.concat(F.lit("https://eplus.jp/"), k.cast("string")).alias("url"),
            F.lit(None).cast("string").alias("code")))).alias("ticket_links"),
        F.when(k % 10 == 0, F.array("p_brand", F.split("p_name", " ")[1], "p_name"))
        .otherwise(F.array("p_brand", F.split("p_name", " ")[1])).alias("lineup"))
    rows = rows.withColumn("source_url", F.concat(
        F.lit("https://"), "source", F.lit(".example/e/"), F.col("k").cast("string")))
    return conform(rows, extra=["k"]).withColumn("id", stable_id(F.col("source"), F.col("source_url")))


#: the same listing for the SQL side
LISTING_SQL = """listing AS (
  SELECT *, substr(sha256(source || '|' || source_url), 1, 16) AS id FROM (
    SELECT *, 'https://' || source || '.example/e/' || k AS source_url FROM (
      SELECT {columns},
        CASE WHEN o_orderkey % 5 = 0
             THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 + 1 AS INT) END AS end_date,
        CASE WHEN o_orderkey % 5 = 0 THEN ['https://eplus.jp/' || o_orderkey] ELSE [] END AS link_urls,
        CASE WHEN o_orderkey % 10 = 0 THEN [p_brand, split_part(p_name, ' ', 2), p_name]
             ELSE [p_brand, split_part(p_name, ' ', 2)] END AS lineup
      FROM orders JOIN part ON o_custkey = p_partkey)))""".format(
    columns=", ".join(f"{e.format(string='VARCHAR')} AS {n}" for n, e in LISTING_COLUMNS.items()))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Halls of the listing as a venue registry; the last has no capacity."""
    number = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf, "orders").select(number.alias("ord")).distinct().select(
        "ord", F.concat(F.lit("hall_"), "ord").alias("venue_key"),
        F.concat(F.lit("Hall "), "ord").alias("display"), F.lit("hall").alias("vclass"),
        F.when(F.col("ord") < 5, F.col("ord") * 1000).alias("capacity"))


def staged(spark: SparkSession, sf: str) -> DataFrame:
    """The listing as a staged table: status by order number, seen times by
    date, hashes as the merge would have stored them."""
    rows = listing(spark, sf)
    day = F.col("start_date").cast("timestamp")
    return rows.withColumn("content_hash", content_hash()) \
        .withColumn("status", F.expr("case when k % 11 < 3 then 'pending' when k % 11 < 6 then 'approved' "
                                     "when k % 11 = 6 then 'rejected' else 'auto' end")) \
        .withColumn("first_seen", day - F.expr("INTERVAL 90 DAYS")) \
        .withColumn("last_seen", day - F.expr("INTERVAL 30 DAYS")) \
        .withColumn("updated_at", day - F.expr("INTERVAL 60 DAYS"))


STAGED_SQL = LISTING_SQL + """, staged AS (
  SELECT *, CASE WHEN k % 11 < 3 THEN 'pending' WHEN k % 11 < 6 THEN 'approved'
                 WHEN k % 11 = 6 THEN 'rejected' ELSE 'auto' END AS status,
         start_date - 90 AS first_day, start_date - 30 AS last_day, start_date - 60 AS updated_day
  FROM listing)"""

"""Filters, classification, work queues, reports, sources, sinks, streaming."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from checks.base import (LISTING_SQL, ORACLES, PROMOTERS, QUERIES, STAGED_SQL, as_of, check, listing, now, registry,
                         staged, table, texts)
from checks.entity import _BATCH_SQL, _RECURSIVE_PARTS, festival_hosts, fold_sql, keyed, keyed_by_number, merged, stored_and_batch
from playbill.functions import dates, flags
from playbill.operators import classify, overlap, quality, ranking, select, workqueue
from playbill.sinks import calendar, feed, lines, runs
from playbill.sources import editions, feeds, pages as page_source, staged as stage_source
from playbill.streaming import ingest

_STAGED = "WITH " + STAGED_SQL
_LISTING = "WITH " + LISTING_SQL
DAY = "DATE '1998-06-01'"

# --- filters ----------------------------------------------------------------


@check("flt_1_listing", _STAGED + """
SELECT id, CAST(start_date AS VARCHAR) AS start_date, title_ja FROM staged WHERE status IN ('approved', 'auto')
  AND category = 'music' AND start_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""")
def flt_1(spark, sf):
    rows = select.list_events(staged(spark, sf), category="music", date_from=F.lit("1997-01-01").cast("date"),
                              date_to=F.lit("1999-12-31").cast("date"), public_only=True)
    return rows.select("id", F.col("start_date").cast("string").alias("start_date"), "title_ja")


@check("flt_2_upcoming", _LISTING + f"""
SELECT k FROM listing WHERE coalesce(end_date, start_date) >= {DAY} AND category <> 'other'""")
def flt_2(spark, sf):
    return select.upcoming(listing(spark, sf), as_of()).select("k")


@check("flt_3_local_day", "SELECT event_id, CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day FROM events")
def flt_3(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.local_day(F.col("ts")).cast("string").alias("day"))


@check("flt_4_public", _STAGED + " SELECT id FROM staged WHERE k % 11 BETWEEN 3 AND 5 OR k % 11 > 6")
def flt_4(spark, sf):
    return staged(spark, sf).filter(select.is_public()).select("id")


def scoped(spark, sf):
    """Suppliers as halls: registered ones below balance 5000, in scope by nation."""
    halls = table(spark, sf, "supplier").selectExpr("s_suppkey", "s_name", "s_nationkey < 10 in_scope")
    known = table(spark, sf, "supplier").filter("s_acctbal < 5000").selectExpr(
        "s_suppkey _k", "concat('v', s_suppkey) venue_key")
    rows = halls.join(known, F.col("s_suppkey") == F.col("_k"), "left").drop("_k")
    return select.scope_gate(rows, "venue_key", F.col("in_scope"))


@check("flt_5_scope_gate", """SELECT s_suppkey, CASE WHEN s_acctbal < 5000 THEN 'kept' ELSE 'gap' END AS part
FROM supplier WHERE s_acctbal < 5000 OR s_nationkey < 10""")
def flt_5(spark, sf):
    kept, gaps = scoped(spark, sf)
    return kept.select("s_suppkey", F.lit("kept").alias("part")).unionByName(
        gaps.select("s_suppkey", F.lit("gap").alias("part")))


@check("flt_6_listable", "SELECT p_partkey FROM part WHERE p_partkey % 5 = 4 AND p_name NOT LIKE 'old%'")
def flt_6(spark, sf):
    title = F.expr("case p_partkey % 5 when 0 then '  ' when 1 then 'Coming Soon' when 2 then '貸切営業' "
                   "when 3 then '設備メンテナンス' else p_name end")
    return table(spark, sf, "part").filter(flags.is_listable(title, extra="^old")).select("p_partkey")


@check("flt_7_horizon", _LISTING + f" SELECT k FROM listing WHERE start_date >= {DAY} AND start_date < DATE '1998-12-01'")
def flt_7(spark, sf):
    return select.within_horizon(listing(spark, sf), as_of(), 6).select("k")


@check("flt_8_served", _STAGED + """ SELECT source, source_url, title_ja, category, venue_name, is_sold_out FROM staged""")
def flt_8(spark, sf):
    shown = select.served(staged(spark, sf))
    assert not {"id", "status", "price_text", "tags"} & set(shown.columns)
    return shown.select("source", "source_url", "title_ja", "category", "venue_name", "is_sold_out")


@check("flt_9_missing_detail", _LISTING + """
SELECT k, len(link_urls) = 0 OR start_time IS NULL OR price_min IS NULL AS any_missing,
  len(link_urls) = 0 AND start_time IS NULL AND price_min IS NULL AND is_free IS NULL AS none_found FROM listing""")
def flt_9(spark, sf):
    return listing(spark, sf).select("k", select.any_detail_missing().alias("any_missing"),
                                     select.no_detail_at_all().alias("none_found"))


# --- classification ---------------------------------------------------------

#: rules in the documents' own words, in both dialects alike
RULES = (("licence", r"(?i)licensed? under"), ("article", r"(?i)\bthe\b"), ("liaison", r"(?i) und | et "),
         ("digits", r"[0-9]{4,}"), ("marks", r"[#$%&]{3}"))


def _hits(rules=RULES) -> str:
    return "[" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{g}' END" for g, p in rules) + "]"


@check("cls_1_rule_labels", f"""SELECT doc_id, array_to_string(list_filter({_hits()}, lambda x: x IS NOT NULL)[1:2], ',') AS labels
FROM documents""")
def cls_1(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.array_join(
        classify.rule_labels(F.col("text"), RULES, compound=None), ",").alias("labels"))


@check("cls_1_rule_genres", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'idol,jazz-soul' WHEN 1 THEN 'electronic'
  WHEN 2 THEN 'classical,international' WHEN 3 THEN 'anime-seiyu' WHEN 4 THEN 'j-rock' ELSE '' END AS genres,
  p_partkey % 6 < 4 AS confident FROM part""")
def cls_1b(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey", "case when p_partkey % 6 = 4 then 'liquidroom' else 'hall' end source",
        "case p_partkey % 6 when 0 then 'アイドル生誕祭 JAZZ night' when 1 then 'ALL NIGHT' when 2 then 'Orchestra' else p_name end title_ja",
        "case p_partkey % 6 when 2 then 'Japan Tour' end title_en", "cast(null as string) subtitle",
        "case p_partkey % 6 when 1 then array('DJ X') else array() end lineup",
        "case p_partkey % 6 when 3 then array('声優') else array() end tags")
    return classify.rule_genres(rows).select("p_partkey", F.array_join("rule_genres", ",").alias("genres"), "confident")


@check("cls_2_first_label", f"""SELECT doc_id, coalesce(list_filter({_hits()}, lambda x: x IS NOT NULL)[1], lang) AS label FROM documents""")
def cls_2(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.coalesce(
        classify.first_label(F.col("text"), RULES), "lang").alias("label"))


@check("cls_2_art_genres", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'photography' WHEN 1 THEN 'design'
  WHEN 2 THEN 'western-art' ELSE '' END AS genre FROM part""")
def cls_2b(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey", "case p_partkey % 4 when 2 then 'nmwa' when 3 then 'tobikan' else 'nezu' end source",
        "case p_partkey % 4 when 0 then '写真とデザイン' when 1 then '建築' else p_name end title_ja", "'x' title_en")
    return rows.select("p_partkey", F.array_join(classify.art_genres(), ",").alias("genre"))


@check("cls_3_event_text", _LISTING + """
SELECT k, concat_ws(' ', title_ja, title_en, array_to_string(lineup, ' ')) AS text FROM listing""")
def cls_3(spark, sf):
    return listing(spark, sf).select("k", classify.event_text().alias("text"))


def genre_cache(spark, sf):
    return table(spark, sf, "labels").selectExpr("doc_id k", "array(case quality when 1 then 'idol' else 'k-pop' end) genres") \
        .join(listing(spark, sf).selectExpr("k", "id event_id"), "k").select("event_id", "genres")


_GENRES = _LISTING + """, c AS (SELECT doc_id AS k, CASE quality WHEN 1 THEN 'idol' ELSE 'k-pop' END AS cached FROM labels),
 g AS (SELECT l.*, k % 10 = 3 AS preset, cached FROM listing l LEFT JOIN c USING (k))"""


def genre_rows(spark, sf):
    rows = listing(spark, sf).withColumn("genres", F.when(F.col("k") % 10 == 3, F.array(F.lit("classical")))
                                         .otherwise(F.array().cast("array<string>")))
    return classify.apply_genres(rows, genre_cache(spark, sf))


@check("cls_4_genres", _GENRES + """
SELECT k, CASE WHEN preset THEN 'classical' WHEN category IN ('music', 'music_festival') THEN coalesce(cached, '') ELSE '' END AS genres,
  category IN ('music', 'music_festival') AND NOT preset AND cached IS NULL AS uncertain FROM g""")
def cls_4(spark, sf):
    return genre_rows(spark, sf).select("k", F.array_join("genres", ",").alias("genres"), "uncertain")


@check("cls_5_verdict_queue", _GENRES + """, q AS (
  SELECT id, k, row_number() OVER (ORDER BY start_date, id) AS queue_pos FROM g
  WHERE category IN ('music', 'music_festival') AND NOT preset AND cached IS NULL), t AS (
  SELECT * FROM q WHERE queue_pos <= 150)
SELECT id AS event_id, CAST((queue_pos - 1) // 20 AS INT) AS batch_no, CASE k % 3 WHEN 0 THEN 'jazz-soul,idol' ELSE '' END AS genres
FROM t WHERE k % 3 < 2""")
def cls_5(spark, sf):
    queue = classify.verdict_queue(genre_rows(spark, sf).filter("uncertain"), [F.col("start_date"), F.col("id")])
    said = queue.selectExpr("id event_id", "case k % 3 when 0 then array('polka', 'jazz-soul', 'idol', 'k-pop') "
                            "when 1 then array('polka') end verdict", "'tagger' tagger")
    fresh = classify.accept_verdicts(queue, said)
    return fresh.join(queue.selectExpr("id event_id", "batch_no"), "event_id").select(
        "event_id", "batch_no", F.array_join("genres", ",").alias("genres"))


@check("cls_6_mostly_ascii", r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS d FROM documents)
SELECT doc_id, (length(d) - length(regexp_replace(d, '[\x00-\x7f]', '', 'g'))) * 10 >= length(d) * 7 AS ascii FROM t""")
def cls_6(spark, sf):
    from playbill.functions.text import mostly_ascii
    return texts(spark, sf, "documents").select("doc_id", mostly_ascii(F.col("text")).alias("ascii"))


@check("cls_7_title_en", """SELECT doc_id AS id, CASE WHEN has THEN 'en' WHEN doc_id % 2 = 0 THEN coalesce('mt ' || quality, NULL) END AS title_en,
  CASE WHEN NOT has AND doc_id % 2 = 0 AND quality IS NOT NULL THEN true END AS title_en_mt,
  NOT has AND doc_id % 2 = 0 AND quality IS NULL AS title_queued
FROM (SELECT doc_id, lang = 'de' AS has FROM documents) LEFT JOIN labels USING (doc_id)""")
def cls_7(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id id", "case when doc_id % 2 = 0 then '東京公演 A' else text end title_ja", "case when lang = 'de' then 'en' end title_en")
    rows = rows.withColumn("title_ja", F.when(F.col("id") % 2 == 0, F.col("title_ja")).otherwise("plain title"))
    cache = table(spark, sf, "labels").selectExpr("doc_id event_id", "concat('mt ', quality) title_en")
    return classify.apply_title_en(rows, cache).select("id", "title_en", "title_en_mt", "title_queued")


@check("cls_7_title_queue", """WITH q AS (
  SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents WHERE lang <> 'de' AND doc_id % 3 > 0), r AS (
  SELECT id, CAST(pos AS INT) AS queue_pos, CAST((pos - 1) // 20 AS INT) AS batch_no FROM q WHERE pos <= 200)
SELECT r.*, 'en ' || id AS title_en FROM r WHERE id % 7 > 0 UNION ALL SELECT r.*, NULL FROM r WHERE id % 7 = 0""")
def cls_7b(spark, sf):
    """The titles of one run's budget in batches, and the answers accepted."""
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id id", "n_chars", "case when doc_id % 3 = 0 then 'plain title' else '東京公演' end title_ja",
        "case when lang = 'de' then 'en' end title_en")
    cache = spark.createDataFrame([], "event_id long, title_en string")
    queue = classify.title_queue(classify.apply_title_en(rows, cache), [F.col("n_chars").desc(), F.col("id")])
    # blank answers, and answers nobody asked for
    said = table(spark, sf, "documents").selectExpr("doc_id event_id", "case when doc_id % 7 = 0 then ' ' else concat('en ', doc_id) end title_en")
    got = classify.accept_titles(queue, said).withColumnRenamed("event_id", "id")
    return queue.select("id", "queue_pos", "batch_no").join(got, "id", "left")


@check("jn_16_caches", _LISTING + """, v AS (SELECT doc_id, CASE quality WHEN 1 THEN 'idol' ELSE 'k-pop' END AS genre FROM labels)
SELECT id AS event_id, genre FROM listing JOIN v ON k = doc_id UNION ALL
SELECT id, 'new' FROM listing WHERE k NOT IN (SELECT doc_id FROM labels)""")
def jn_16(spark, sf):
    cache = genre_cache(spark, sf)
    fresh = listing(spark, sf).join(
        table(spark, sf, "labels"), F.col("k") == F.col("doc_id"), "left_anti") \
        .selectExpr("id event_id", "array('new') genres")
    return classify.upsert_cache(cache, fresh).select("event_id", F.col("genres")[0].alias("genre"))


# --- work queues ------------------------------------------------------------

_TRIES = _STAGED + """, tries AS (SELECT id AS event_id, k % 4 AS attempts, k % 3 = 0 AS moved FROM staged WHERE k % 2 = 0)"""


def tries(spark, sf):
    return staged(spark, sf).filter("k % 2 = 0").selectExpr(
        "id event_id", "cast(k % 4 as int) attempts", "case when k % 3 = 0 then 'x' else content_hash end content_hash",
        "cast(null as timestamp) last_attempt")


@check("jn_17_attempts_join", _TRIES + """
SELECT id, coalesce(attempts, 0) AS attempts FROM staged LEFT JOIN tries ON id = event_id""")
def jn_17(spark, sf):
    return workqueue.with_attempts(staged(spark, sf), tries(spark, sf)).select(
        "id", F.coalesce("attempts", F.lit(0)).alias("attempts"))


_BACKLOG = f"""SELECT staged.* FROM staged LEFT JOIN tries ON id = event_id WHERE status <> 'rejected' AND category <> 'other'
  AND coalesce(end_date, start_date) >= {DAY} AND len(link_urls) = 0 AND start_time IS NULL AND price_min IS NULL
  AND is_free IS NULL AND NOT (coalesce(attempts, 0) >= 2 AND NOT moved)"""
_RECHECK = f"""SELECT * FROM staged WHERE status <> 'rejected' AND category = 'music' AND NOT is_sold_out
  AND start_date BETWEEN {DAY} AND DATE '1998-06-11'"""


@check("win_2_backlog", _TRIES + f" SELECT id FROM ({_BACKLOG})")
def win_2(spark, sf):
    return workqueue.backlog(staged(spark, sf), tries(spark, sf), as_of()).select("id")


@check("win_3_recheck", _STAGED + f" SELECT id FROM ({_RECHECK})")
def win_3(spark, sf):
    return workqueue.sold_out_recheck(staged(spark, sf), as_of()).select("id")


@check("win_1_budget", _TRIES + f""", t AS (
  SELECT source, source_url, id, 1 AS tier, source_url AS o FROM staged
    WHERE start_date >= {DAY} AND (len(link_urls) = 0 OR start_time IS NULL OR price_min IS NULL)
  UNION ALL SELECT source, source_url, id, 2, CAST(start_date AS VARCHAR) FROM ({_BACKLOG})
  UNION ALL SELECT source, source_url, id, 3, CAST(start_date AS VARCHAR) FROM ({_RECHECK})), f AS (
  SELECT source, source_url, arg_min(id, (tier, o, id)) AS id, min(tier) AS tier, arg_min(o, (tier, o, id)) AS o FROM t GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tier, o, id) AS queue_pos FROM f)
SELECT source, id, tier, queue_pos FROM r WHERE queue_pos <= 40""")
def win_1(spark, sf):
    rows = staged(spark, sf)
    fresh = rows.withColumn("outcome", F.when(F.col("start_date") >= as_of(), "new"))
    by_date = [F.col("start_date"), F.col("id")]
    queue = workqueue.work_queue((
        (workqueue.fresh_work(fresh), [F.col("source_url"), F.col("id")]),
        (workqueue.backlog(rows, tries(spark, sf), as_of()), by_date),
        (workqueue.sold_out_recheck(rows, as_of()), by_date)))
    return queue.select("source", "id", "tier", "queue_pos")


@check("win_1_supplier_top40", """SELECT l_suppkey, l_orderkey, l_extendedprice, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_partkey,
    l_extendedprice) AS rn FROM lineitem) WHERE rn <= 40""")
def win_1b(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice", "l_returnflag", "l_shipdate",
                                               "l_linenumber", "l_partkey")
    order = [F.col(c) for c in ("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return ranking.top_per_key(rows, ["l_suppkey"], order, 40, "rn").select("l_suppkey", "l_orderkey", "l_extendedprice", "rn")


def run_rows(spark, sf):
    """Events as run rows: the event type is the source, an error is a failed run."""
    return table(spark, sf, "events").selectExpr(
        "event_id run_id", "concat(event_type, '_', user_id % 7) source", "cast(value as bigint) found", "user_id new",
        "user_id % 5 changed", "case when user_id % 4 = 0 then concat('failed ', user_id) end error")


@check("win_4_latest_run", """SELECT event_type || '_' || user_id % 7 AS source, max(event_id) AS run_id,
  arg_max(user_id, event_id) AS new FROM events GROUP BY 1""")
def win_4(spark, sf):
    return quality.latest_runs(run_rows(spark, sf)).select("source", "run_id", "new")


_STALE = f"""SELECT * FROM staged WHERE status IN ('approved', 'auto') AND coalesce(end_date, start_date) >= {DAY}
  AND CAST(last_day AS TIMESTAMP) < TIMESTAMP '1998-06-01 03:00:00' - INTERVAL 3 DAY"""


@check("win_5_stale", _STAGED + f" SELECT id, CAST(last_day AS VARCHAR) AS last_seen, title_ja AS title FROM ({_STALE})")
def win_5(spark, sf):
    return workqueue.stale_upcoming(staged(spark, sf), as_of(), now()).select(
        "id", F.col("last_seen").cast("string").alias("last_seen"), "title")


@check("win_6_group_budget", """WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderdate), o_custkey) AS rn
  FROM orders GROUP BY o_custkey) SELECT o_orderkey, rn <= 25 AS fetch FROM orders JOIN g USING (o_custkey)""")
def win_6(spark, sf):
    return workqueue.split_by_group_budget(table(spark, sf, "orders"), "o_custkey", "o_orderdate").select("o_orderkey", "fetch")


@check("win_6_deferred", """WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderdate), o_custkey) AS rn
  FROM orders GROUP BY o_custkey)
SELECT o_custkey || '#' || CAST(o_orderdate AS DATE) AS source_url, bool_or(o_orderstatus = 'P') AS is_sold_out
FROM orders JOIN g USING (o_custkey) WHERE rn > 25 GROUP BY o_custkey, o_orderdate""")
def win_6b(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_custkey", "cast(o_orderdate as date) day", "o_orderpriority title_ja",
                                                 "o_orderstatus = 'P' is_sold_out")
    return workqueue.deferred_rows(workqueue.split_by_group_budget(rows, "o_custkey", "day"), "o_custkey", "day") \
        .select("source_url", "is_sold_out")


@check("win_7_calendar_order", _LISTING + """
SELECT source, arg_min(k, (start_date, coalesce(start_time, ''), id)) AS first_k FROM listing GROUP BY source""")
def win_7(spark, sf):
    return ranking.first_per_key(listing(spark, sf).select("source", "k", "start_date", "start_time", "id"), ["source"],
                                 workqueue.sort_key()).select("source", F.col("k").alias("first_k"))


@check("win_8_carry_forward", """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS card FROM events""")
def win_8(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "user_id % 3 u", "case when event_type = 'signup' then event_id end m")
    return ranking.carry_forward(rows, ["u"], [F.col("event_id")], "m", "card") \
        .select("event_id", "card")


# --- accounting and reports -------------------------------------------------


@check("agg_1_counters", _BATCH_SQL + """
SELECT source, count(*) AS found, count(*) FILTER (outcome = 'new') AS "new", count(*) FILTER (outcome = 'changed') AS changed,
  count(*) FILTER (outcome = 'unchanged') AS unchanged FROM judged WHERE outcome IS NOT NULL GROUP BY source""")
def agg_1(spark, sf):
    return quality.run_counters(merged(spark, sf)).drop("details")


#: a supplier's month is a source; the supplier itself has no rows
MONTHLY = "concat('s', l_suppkey, '_', date_format(l_shipdate, 'yyyyMM'))"


def source_rows(spark, sf):
    own = table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey) source", "s_suppkey k")
    monthly = table(spark, sf, "lineitem").selectExpr(f"{MONTHLY} source", "l_suppkey k").distinct()
    return own.unionByName(monthly).selectExpr("source", "k % 5 = 0 allow_empty", "k % 3 > 0 supports_detail",
                                               "'pending' default_status")


_ERRORS = """WITH c AS (SELECT 's' || l_suppkey || '_' || strftime(l_shipdate, '%Y%m') AS source, l_suppkey, count(*) AS found, count(*) FILTER (l_returnflag = 'A') AS ok,
    count(*) FILTER (l_returnflag <> 'A') AS bad FROM lineitem GROUP BY ALL), r AS (
  SELECT 's' || s_suppkey AS source, s_suppkey % 5 = 0 AS allow_empty, 0 AS found, 0 AS ok, 0 AS bad FROM supplier
  UNION ALL SELECT source, l_suppkey % 5 = 0, found, ok, bad FROM c), e AS (
  SELECT *, CASE WHEN found = 0 AND NOT allow_empty THEN '0 events parsed — site structure may have changed'
    WHEN bad >= 3 AND ok = 0 THEN 'detail pass failed for all ' || bad || ' attempted pages' END AS error FROM r)"""


def error_rows(spark, sf):
    fetched = table(spark, sf, "lineitem").selectExpr(
        f"{MONTHLY} source", "l_returnflag = 'A' ok", "'unchanged' outcome")
    return quality.run_errors(source_rows(spark, sf), quality.run_counters(fetched, fetched))


@check("agg_2_run_errors", _ERRORS + " SELECT source, found, error FROM e")
def agg_2(spark, sf):
    return error_rows(spark, sf).select("source", "found", "error")


@check("agg_6_gaps", """WITH u AS (SELECT o_orderpriority AS source, c_name AS venue_name FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_acctbal < 0 OR c_nationkey = 3), d AS (SELECT DISTINCT * FROM u)
SELECT source, 0 AS part, '' AS venue_name, '### `' || source || '` (' || count(*) || ')' AS line FROM d GROUP BY source
UNION ALL SELECT source, 1, venue_name, '- ' || venue_name FROM d""")
def agg_6(spark, sf):
    return quality.gap_report(gap_rows(spark, sf))


def gap_rows(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .selectExpr("o_orderpriority source", "c_name venue_name",
                    "case when not (c_acctbal < 0 or c_nationkey = 3) then 'v' end venue_key")
    from playbill.operators.venues import unresolved_names
    return unresolved_names(rows)


@check("agg_6_gap_totals", """SELECT count(*) AS names, count(DISTINCT o_orderpriority) AS sources FROM (
  SELECT DISTINCT o_orderpriority, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 OR c_nationkey = 3)""")
def agg_6b(spark, sf):
    return quality.gap_totals(gap_rows(spark, sf))


@check("agg_7_stale_report", _STAGED + f""", s AS ({_STALE})
SELECT source, 0 AS part, '' AS id, '### `' || source || '` (' || count(*) || ')' AS line FROM s GROUP BY source
UNION ALL SELECT source, 1, id, '- ' || start_date || ' **' || title_ja || '** — last seen ' || last_day || ', id `' || id || '`' FROM s""")
def agg_7(spark, sf):
    return quality.stale_report(workqueue.stale_upcoming(staged(spark, sf), as_of(), now())).drop("start_date")


@check("agg_7_failures", """WITH h AS (SELECT event_type || '_' || user_id % 7 AS source, arg_max(user_id, event_id) AS u,
    arg_max(CAST(floor(value) AS BIGINT), event_id) AS f FROM events GROUP BY 1)
SELECT source, unnest([0, 1, 2]) AS part, unnest(['### `' || source || '`', 'found=' || f || ' new=' || u || ' changed=' || u % 5,
  'failed ' || u]) AS line FROM h WHERE u % 4 = 0""")
def agg_7b(spark, sf):
    return quality.failure_report(quality.latest_runs(run_rows(spark, sf)))


def fates(spark, sf):
    """The listing and one festival per part type in the first quarter of 1995."""
    festivals = table(spark, sf, "part").selectExpr("p_type venue_name").distinct().selectExpr(
        "-1 - row_number() over (order by venue_name) k", "'festivals' source", "venue_name", "concat('f_', venue_name) venue_key",
        "date'1995-01-01' start_date", "date'1995-03-31' end_date", "false is_sold_out") \
        .withColumns({"id": F.col("k"), "ord": F.col("k")})
    rows = keyed_by_number(spark, sf)
    rows = rows.unionByName(festivals.select(*[F.col(c).cast(t) for c, t in rows.select(*festivals.columns).dtypes]),
                            allowMissingColumns=True)
    return overlap.merge_promoters(rows, PROMOTERS, "festivals", festival_hosts(spark, sf))


@check("agg_8_duplicate_classes", ORACLES["jn_20_duplicate_groups"].replace("\nSELECT CAST(g.start_date", ", cl AS (SELECT CAST(g.start_date")
       + ") SELECT class, count(*) AS groups FROM cl GROUP BY class")
def agg_8(spark, sf):
    return QUERIES["jn_20_duplicate_groups"](spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("groups"))


@check("agg_9_fates", _RECURSIVE_PARTS + """, dup AS (SELECT k FROM listing
    WHERE start_date BETWEEN DATE '1995-01-01' AND DATE '1995-03-31' AND EXISTS (SELECT 1 FROM (SELECT DISTINCT p_type FROM part)
      WHERE contains(lower(title_ja), lower(p_type)) AND (source LIKE 'promo%' OR venue_name = 'Hall ' || (1 + (2 + length(p_type)) % 5)))),
  seen AS (SELECT DISTINCT promo_k AS k FROM overlap WHERE promo_k NOT IN (SELECT k FROM dup))"""
       + fold_sql("""SELECT k FROM listing WHERE source LIKE 'promo%' AND k NOT IN (SELECT k FROM dup)
  AND k NOT IN (SELECT k FROM seen)""") + """, all_fates AS (
  SELECT CASE WHEN k IN (SELECT k FROM dup) THEN 'festival' WHEN k IN (SELECT k FROM seen) THEN 'venue'
    WHEN k IN (SELECT k FROM folded WHERE home IS NOT NULL) THEN 'promoter' ELSE 'kept' END AS fate FROM listing
  UNION ALL SELECT 'kept' FROM (SELECT DISTINCT p_type FROM part))
SELECT fate, count(*) AS rows FROM all_fates GROUP BY fate""")
def agg_9(spark, sf):
    return quality.merge_counters(fates(spark, sf)[1])


@check("agg_10_coverage", _LISTING + f""", m AS (SELECT source, category, count(*) AS rows,
  avg(CAST(price_min IS NOT NULL OR is_free IS NOT NULL AS INT)) AS price, avg(CAST(start_time IS NOT NULL AS INT)) AS start_time,
  avg(CAST(len(link_urls) > 0 AS INT)) AS ticket_links, avg(CAST(title_en IS NOT NULL AS INT)) AS title_en,
  avg(CAST(coalesce(end_date, start_date) < {DAY} AS INT)) AS past FROM listing GROUP BY ROLLUP (source, category))
SELECT coalesce(source, 'all') AS source, coalesce(category, 'all') AS category, rows, CAST(round(price * 10000) AS BIGINT) AS price,
  CAST(round(start_time * 10000) AS BIGINT) AS start_time, CAST(round(ticket_links * 10000) AS BIGINT) AS ticket_links,
  CAST(round(title_en * 10000) AS BIGINT) AS title_en, CAST(round(past * 10000) AS BIGINT) AS past FROM m""")
def agg_10(spark, sf):
    rows = listing(spark, sf).withColumn("artists", F.col("lineup"))
    out = quality.coverage(rows, as_of(), ["source", "category"])
    return out.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("category", F.lit("all")).alias("category"),
                      "rows", *[F.round(F.col(c) * 10000).cast("bigint").alias(c)
                                for c in ("price", "start_time", "ticket_links", "title_en", "past")])


@check("agg_10_churn", _BATCH_SQL + " SELECT outcome, count(*) AS rows FROM judged WHERE outcome IS NOT NULL GROUP BY outcome")
def agg_10b(spark, sf):
    return quality.churn(merged(spark, sf))


@check("agg_11_capacity", """SELECT DISTINCT 'hall_' || substr(o_orderpriority, 1, 1) AS venue_key,
  1000 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS capacity FROM orders JOIN part ON o_custkey = p_partkey
WHERE o_orderpriority < '5'""")
def agg_11(spark, sf):
    return quality.capacity_map(keyed(spark, sf), registry(spark, sf))


@check("jn_18_live_health", """WITH h AS (SELECT event_type || '_' || user_id % 7 AS source, max(event_id) AS run_id FROM events GROUP BY 1)
SELECT source, run_id FROM h WHERE source NOT LIKE 'error%'""")
def jn_18(spark, sf):
    health = quality.latest_runs(run_rows(spark, sf))
    live = run_rows(spark, sf).filter("source not like 'error%'").select("source").distinct()
    return quality.live_health(health, live).select("source", "run_id")


@check("jn_19_stale_of_healthy", _STAGED + f""" SELECT id FROM ({_STALE}) WHERE source <> 'hall_2'""")
def jn_19(spark, sf):
    rows = staged(spark, sf)
    health = rows.select("source").distinct().withColumn("error", F.when(F.col("source") == "hall_2", "boom"))
    return quality.stale_of_healthy(workqueue.stale_upcoming(rows, as_of(), now()), health).select("id")


# --- set operations ---------------------------------------------------------


@check("set_1_union_new", """SELECT o_orderkey, 'first' AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL
SELECT o_orderkey, 'second' FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus <> 'F'""")
def set_1(spark, sf):
    orders = table(spark, sf, "orders")
    first = orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("first").alias("part"))
    more = orders.filter("o_orderdate < timestamp_ntz'1998-01-01'").select("o_orderkey", F.lit("second").alias("part"))
    return select.union_new(first, more, ["o_orderkey"])


@check("set_3_unknown_sources", """SELECT DISTINCT source FROM documents WHERE source NOT IN (
  SELECT 'src' || s_suppkey FROM supplier WHERE s_suppkey < 10)""")
def set_3(spark, sf):
    known = table(spark, sf, "supplier").filter("s_suppkey < 10").selectExpr("concat('src', s_suppkey) source")
    return select.unknown_sources(table(spark, sf, "documents"), known)


@check("set_4_promoter_groups", _LISTING + """
SELECT CAST(start_date AS VARCHAR) AS start_date, bool_or(source LIKE 'promo%') AS involved FROM listing GROUP BY start_date""")
def set_4(spark, sf):
    return listing(spark, sf).groupBy("start_date").agg(F.collect_set("source").alias("s")).select(
        F.col("start_date").cast("string").alias("start_date"), select.involves(F.col("s"), PROMOTERS).alias("involved"))


@check("set_5_soonest", _LISTING + " SELECT id FROM listing ORDER BY start_date, id LIMIT 50")
def set_5(spark, sf):
    return select.first_by_date(listing(spark, sf), 50).select("id")


# --- sources ----------------------------------------------------------------


@check("src_1_pages", r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^(www|m)\.', '') AS source,
  length(html) AS n FROM pages""")
def src_1(spark, sf):
    rows = page_source.read_pages(spark, f"{sf}/pages.parquet")
    return rows.select("page_id", "source", F.length("html").alias("n"))


@check("src_2_feed", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""")
def src_2(spark, sf):
    payloads = table(spark, sf, "events").select("event_id", F.concat(
        F.lit('{"contents":['), "props", F.lit(', 7]}')).alias("payload"))
    schema = "struct<contents: array<string>>"
    rows = feeds.parse_feed(payloads, "payload", schema, rows="contents", strict=True)
    return feeds.parse_feed(rows.select("event_id", F.col("row").alias("entry")).filter("entry like '{%'"),
                            "entry", "struct<k: int>").select("event_id", F.col("row.k").alias("k"))


@check("src_2_malformed", "SELECT count(*) AS malformed FROM documents WHERE length(text) > 0")
def src_2b(spark, sf):
    return feeds.malformed(table(spark, sf, "documents").withColumn("p", F.concat(F.lit("<"), "text")), "p", "struct<k: int>")


@check("src_3_nested", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'en' ELSE 'ja' END || o_custkey AS url,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'first' END AS headline, o_orderstatus = 'P' AS sold_out FROM orders""")
def src_3(spark, sf):
    doc = F.expr("""concat('{"urls":[{"culture":"ja-JP","value":"ja', o_custkey, '"}',
      case when o_orderkey % 3 = 0 then concat(',{"culture":"en-US","value":"en', o_custkey, '"}') else '' end,
      '],"artists":[{"name":"first"},{"name":"', o_orderpriority, '","headline":', o_orderkey % 2 = 0, '}],"tickets":[{"status":"OnSale"},',
      '{"status":"', case when o_orderstatus = 'P' then 'soldOut' else 'OnSale' end, '"}]}')""")
    rows = feeds.parse_feed(table(spark, sf, "orders").withColumn("doc", doc), "doc",
                            "struct<urls: array<struct<culture: string, value: string>>, artists: array<struct<name: string, "
                            "headline: boolean>>, tickets: array<struct<status: string>>>", strict=True)
    return rows.select("o_orderkey", feeds.localised(F.col("row.urls"), "en-US").alias("url"),
                       feeds.first_headline(F.col("row.artists")).alias("headline"),
                       feeds.any_status(F.col("row.tickets"), "SoldOut").alias("sold_out"))


@check("src_4_registry", "SELECT 's' || s_suppkey AS venue_key, 'duplicate venue key' AS problem FROM supplier WHERE s_acctbal < 1000")
def src_4(spark, sf):
    from playbill.operators.venues import check_registry
    sup = table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey) venue_key", "s_acctbal")
    return check_registry(sup.unionByName(sup.filter("s_acctbal < 1000"))).select(
        F.col("value").alias("venue_key"), "problem")


_EDITIONS = """WITH d AS (SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS day FROM lineitem), e AS (
  SELECT k, list_sort(list(DISTINCT day)) AS days FROM d GROUP BY k)"""


def edition_rows(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sort_array(F.collect_set(F.col("l_shipdate").cast("date"))).alias("dates")) \
        .withColumn("url", F.concat(F.lit("/e/"), F.col("k").cast("string"))) \
        .withColumn("contiguous", F.col("k") % 2 == 0)


@check("src_5_editions", _EDITIONS + f""", r AS (
  SELECT k, days[1] AS s, days[-1] AS e, false AS many FROM e WHERE k % 2 = 0 UNION ALL
  SELECT k, unnest(days), unnest(days), len(days) > 1 FROM e WHERE k % 2 = 1)
SELECT k, '/e/' || k || CASE WHEN many THEN '#' || s ELSE '' END AS source_url, CAST(s AS VARCHAR) AS start_date,
  CAST(nullif(e, s) AS VARCHAR) AS end_date FROM r WHERE e >= {DAY}""")
def src_5(spark, sf):
    return editions.expand_editions(edition_rows(spark, sf), as_of()).select(
        "k", "source_url", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"))


@check("src_5_day_split", _EDITIONS + f"""
SELECT k, '/e/' || k || CASE WHEN len(days) > 1 THEN '#' || day ELSE '' END AS source_url FROM (
  SELECT *, unnest(days) AS day FROM e WHERE days[-1] >= {DAY})""")
def src_5b(spark, sf):
    return editions.split_by_day(edition_rows(spark, sf), as_of()).select("k", "source_url")


def scratch(spark):
    """Shared folder the cluster names; a local one in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    import uuid
    return f"{base.rstrip('/')}/playbill-{uuid.uuid4().hex}"


@check("src_6_migration", _LISTING + " SELECT id, source, title_ja, category, 0 AS n_tags FROM listing")
def src_6(spark, sf):
    root = scratch(spark)
    old = staged(spark, sf).drop("tags", "lat", "lng", "k")
    old.write.mode("overwrite").parquet(root)
    rows = stage_source.read_table(spark, root)
    return rows.select("id", "source", "title_ja", "category", F.size("tags").alias("n_tags"))


# --- sinks ------------------------------------------------------------------


@check("snk_1_feed", _LISTING + f""", e AS (SELECT *, row_number() OVER (ORDER BY start_date, id) AS rn FROM listing
  WHERE coalesce(end_date, start_date) >= {DAY} AND category <> 'other'), s AS (
  SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) AS rn FROM e GROUP BY source), v AS (
  SELECT source, CAST(source[6:] AS INT) * 1000 AS room, row_number() OVER (ORDER BY source) AS rn FROM s
  WHERE source LIKE 'hall_%' AND CAST(source[6:] AS INT) < 5)
SELECT 0 AS part, '' AS id, '{{"generated_at":"1998-06-01T03:00:00+00:00","sources":[' AS line UNION ALL
SELECT 1, source, CASE WHEN rn > 1 THEN ',' ELSE '' END || '{{"source":"' || source || '","found":' || n || ',"error":null}}' FROM s UNION ALL
SELECT 2, '', '],"venues":{{' UNION ALL
SELECT 3, source, CASE WHEN rn > 1 THEN ',' ELSE '' END || '"' || source || '":{{"capacity":' || room || '}}' FROM v UNION ALL
SELECT 4, '', '}},"events":[' UNION ALL
SELECT 5, id, CASE WHEN rn > 1 THEN ',' ELSE '' END || '{{"source":"' || source || '","title_ja":"' || title_ja || '","start_date":"'
  || start_date || '","end_date":' || coalesce('"' || end_date || '"', 'null') || '}}' FROM e UNION ALL
SELECT 6, '', ']}}'""")
def snk_1(spark, sf):
    rows = select.upcoming(listing(spark, sf), as_of()).select("id", "source", "title_ja", "start_date", "end_date") \
        .withColumn("venue_key", F.col("source"))
    health = rows.groupBy("source").agg(F.count(F.lit(1)).alias("found")).withColumn("error", F.lit(None).cast("string"))
    doc = feed.feed_lines(rows.drop("venue_key"), health, quality.capacity_map(rows, registry(spark, sf)), now())
    return doc.select("part", "id", "line")


_ICAL = _LISTING + """, e AS (SELECT *, substr(sha256(source || '|' || source_url), 1, 16) AS uid FROM listing
  WHERE category IN ('music', 'music_festival')), v AS (
  SELECT k, venue_name, unnest(['events', 'ical/' || source]) AS calendar, start_date, coalesce(start_time, '') AS t, uid, [
    'BEGIN:VEVENT', 'UID:' || uid || '@playbill', 'DTSTAMP:19980601T030000Z',
    CASE WHEN start_time IS NOT NULL THEN 'DTSTART;TZID=Asia/Tokyo:' || strftime(start_date, '%Y%m%d') || 'T' || replace(start_time, ':', '') || '00' END,
    CASE WHEN start_time IS NULL THEN 'DTSTART;VALUE=DATE:' || strftime(start_date, '%Y%m%d') END,
    CASE WHEN start_time IS NULL THEN 'DTEND;VALUE=DATE:' || strftime(coalesce(end_date, start_date) + 1, '%Y%m%d') END,
    'SUMMARY:' || title_ja || CASE WHEN is_sold_out THEN ' [SOLD OUT]' ELSE '' END, 'LOCATION:' || venue_name,
    'DESCRIPTION:' || array_to_string(lineup, '\\, ') || coalesce('\\n' || CASE WHEN coalesce(price_min, 0) <> 0
      THEN '¥' || replace(format('{:,}', price_min), ',', '\\,') || '~' WHEN is_free THEN 'Free' END, ''),
    'URL:' || source_url, 'END:VEVENT'] AS ls FROM e)"""


def calendar_rows(spark, sf):
    return listing(spark, sf).withColumn("artists", F.col("lineup")).withColumn("venue_key", F.col("source"))


@check("snk_2_calendars", _ICAL + """, c AS (
  SELECT calendar, arg_min(venue_name, (start_date, t, uid)) AS name FROM v GROUP BY calendar), f AS (
  SELECT calendar, ['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//playbill//JP', 'CALSCALE:GREGORIAN',
    'X-WR-CALNAME:Events' || CASE WHEN calendar <> 'events' THEN ' — ' || name ELSE '' END, 'X-WR-TIMEZONE:Asia/Tokyo', 'BEGIN:VTIMEZONE',
    'TZID:Asia/Tokyo', 'BEGIN:STANDARD', 'DTSTART:19700101T000000', 'TZOFFSETFROM:+0900', 'TZOFFSETTO:+0900', 'TZNAME:JST',
    'END:STANDARD', 'END:VTIMEZONE'] AS head FROM c), every AS (
  SELECT calendar, 0 AS part, NULL AS start_date, NULL AS start_time, NULL AS uid, unnest(head) AS line, generate_subscripts(head, 1) - 1 AS line_no FROM f
  UNION ALL SELECT calendar, 2, NULL, NULL, NULL, 'END:VCALENDAR', 0 FROM c
  UNION ALL SELECT calendar, 1, CAST(start_date AS VARCHAR), t, uid || '@playbill', unnest(list_filter(ls, lambda x: x IS NOT NULL)),
    generate_subscripts(list_filter(ls, lambda x: x IS NOT NULL), 1) - 1 FROM v)
SELECT calendar, part, start_date, start_time, uid, CAST(line_no AS INT) AS line_no, line FROM every""")
def snk_2(spark, sf):
    """Every line of every calendar, unfolded, at its place."""
    out = calendar.calendar_lines(calendar_rows(spark, sf), now())
    return out.select("calendar", "part", F.col("start_date").cast("string").alias("start_date"), "start_time", "uid", "line_no",
                      F.replace("line", F.lit("\r\n "), F.lit("")).alias("line"))


@check("snk_3_entry_text", _ICAL + """, p AS (SELECT k, calendar, unnest(list_filter(ls, lambda x: x IS NOT NULL)) AS line,
  generate_subscripts(list_filter(ls, lambda x: x IS NOT NULL), 1) - 1 AS line_no FROM v WHERE calendar = 'events')
SELECT k, line_no, line FROM p""")
def snk_3(spark, sf):
    rows = calendar.relevant(calendar_rows(spark, sf))
    return rows.select("k", F.posexplode(calendar.entry_lines(now())).alias("line_no", "line"))


@check("snk_3_fold", r"""SELECT doc_id, length(text) AS n_chars, strlen(text) AS octets, true AS whole, true AS short FROM documents""")
def snk_3b(spark, sf):
    rows = texts(spark, sf, "documents").select("doc_id", "text", calendar.fold_line(F.col("text")).alias("folded"))
    parts = F.split("folded", "\r\n ")
    whole = F.array_join(parts, "") == F.col("text")
    short = F.forall(F.transform(parts, lambda p, i: F.octet_length(p) + F.when(i > 0, 1).otherwise(0)), lambda n: n <= 75)
    return rows.select("doc_id", F.length("text").alias("n_chars"), F.octet_length("text").alias("octets"),
                       whole.alias("whole"), short.alias("short"))


@check("snk_4_run_history", _ERRORS + """, g AS (SELECT DISTINCT 's' || o_custkey % 50 AS source, o_orderpriority AS v FROM orders)
SELECT e.source, found, error, count(v) AS skipped FROM e LEFT JOIN g ON e.source = g.source GROUP BY ALL""")
def snk_4(spark, sf):
    gaps = table(spark, sf, "orders").selectExpr("concat('s', o_custkey % 50) source", "o_orderpriority venue_name")
    report = error_rows(spark, sf)
    root = scratch(spark)
    runs.append_runs(runs.run_rows(report, gaps, F.lit(1).cast("bigint"), now(), now()), root)
    return spark.read.parquet(root).select("source", "found", "error", F.col("skipped_venues").alias("skipped"))


@check("snk_4_run_report", _ERRORS + """ SELECT source, '{"source":"' || source || '","found":' || found || ',"error":'
  || coalesce('"' || error || '"', 'null') || '}' AS line FROM e""")
def snk_4b(spark, sf):
    return runs.run_report(error_rows(spark, sf).select("source", "found", "error"))


@check("snk_1_line_files", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def snk_lines(spark, sf):
    root = scratch(spark)
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_orderkey").cast("string").alias("line"))
    lines.write_lines(rows, root, ["l_orderkey"])
    return spark.read.text(root).groupBy(F.col("value").cast("bigint").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n"))


# --- streaming --------------------------------------------------------------


@check("str_1_ingest", _BATCH_SQL.replace("""SELECT * REPLACE (CASE""", """SELECT * REPLACE (CASE""") + """
SELECT coalesce(id, '') AS id, title_ja, start_time, price_min, is_sold_out, CASE WHEN known AND seen AND outcome = 'changed' THEN 'changed'
  ELSE 'kept' END AS fate FROM judged""")
def str_1(spark, sf):
    stored, fresh = stored_and_batch(spark, sf)
    root, feed_dir, state = scratch(spark), scratch(spark), scratch(spark)

    def drop(rows, hour):
        rows.drop("k", "id", "content_hash", "status", "first_seen", "last_seen", "updated_at").withColumn(
            "observed_at", F.lit(f"1998-06-01 0{hour}:00:00").cast("timestamp")) \
            .write.mode("append").parquet(feed_dir)
        rows_in = ingest.read_observations(spark, feed_dir)
        ingest.ingest(rows_in, root, state).awaitTermination()

    drop(stored, 1)
    drop(fresh, 2)
    final = stage_source.current(spark, root)
    moved = F.col("updated_at") > F.col("first_seen")
    return final.select("id", "title_ja", "start_time", "price_min", "is_sold_out",
                        F.when(moved, "changed").otherwise("kept").alias("fate"))



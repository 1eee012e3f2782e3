"""Identity, merge and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (LISTING_SQL, PROMOTERS, STAGED_SQL, as_of, check, listing, now, registry,
                         staged, table, texts)
from playbill.operators import artists, identity, merge, overlap, select, venues
from playbill.schema import conform

# --- identity ---------------------------------------------------------------


@check("ded_1_stable_id", """SELECT event_id, substr(sha256(event_type || '|' || user_id), 1, 16) AS id FROM events""")
def ded_1(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", identity.stable_id(F.col("event_type"), F.col("user_id")).alias("id"))


@check("ded_2_content_hash", """SELECT p_partkey, substr(sha256(to_json({p_brand: p_brand, p_name: p_name,
  p_partkey: p_partkey, p_size: CASE WHEN p_size > 25 THEN p_size END, p_type: p_type})), 1, 16) AS hash FROM part""")
def ded_2(spark, sf):
    part = table(spark, sf, "part").withColumn("p_size", F.when(F.col("p_size") > 25, F.col("p_size")))
    fields = ["p_type", "p_size", "p_partkey", "p_name", "p_brand"]
    return part.select("p_partkey", identity.content_hash(fields).alias("hash"))


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@check("ded_3_keep_first", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def ded_3(spark, sf):
    rows = table(spark, sf, "lineitem").select(*[c.strip() for c in _LINE.split(",")], "l_shipdate")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return identity.keep_first(rows, ["l_orderkey", "l_linenumber"], order).drop("l_shipdate")


@check("ded_4_keep_richest", """SELECT lang, source, doc_id, length(text) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS rn FROM documents)
WHERE rn = 1""")
def ded_4(spark, sf):
    rows = table(spark, sf, "documents").select("lang", "source", "doc_id", "text")
    return identity.keep_richest(rows, ["lang", "source"], "text", [F.col("doc_id")]) \
        .select("lang", "source", "doc_id", F.length("text").alias("n"))


@check("ded_5_fragments", """WITH l AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS day, l_linenumber,
    l_partkey, l_extendedprice, '/o/' || l_orderkey AS url FROM lineitem), c AS (
  SELECT *, min(day) OVER (PARTITION BY url) <> max(day) OVER (PARTITION BY url) AS spans,
         count(*) OVER (PARTITION BY url, day) AS legs FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, url || CASE WHEN legs > 1
  THEN '#' || day || '-' || l_partkey WHEN spans THEN '#' || day ELSE '' END AS source_url FROM c""")
def ded_5(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "cast(l_shipdate as date) day",
        "concat('/o/', l_orderkey) url")
    return identity.fragment_repeats(rows, "url", "day", "l_partkey").drop("url", "day")


@check("ded_6_ordinals", """SELECT event_id, CASE n WHEN 1 THEN day ELSE day || '-' || n END AS fragment FROM (
  SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
    row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events)""")
def ded_6(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "event_type", "cast(ts as date) day")
    return identity.ordinal_fragment(rows, ["event_type", "day"], [F.col("event_id")], "day").select("event_id", "fragment")


@check("ded_7_span_merge", """SELECT o_custkey, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS start_date,
  CAST(nullif(max(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT)), min(CAST(o_orderdate AS DATE))) AS VARCHAR)
    AS end_date, arg_min(o_orderpriority, (-length(o_orderpriority), o_orderkey)) AS title
FROM orders GROUP BY o_custkey""")
def ded_7(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_custkey", "o_orderkey", "cast(o_orderdate as date) start_date",
        "case when o_orderkey % 5 > 0 then date_add(cast(o_orderdate as date), cast(o_orderkey % 5 as int)) end end_date",
        "o_orderpriority title")
    out = identity.merge_spans(rows, ["o_custkey"], "start_date", "end_date", "title", [F.col("o_orderkey")])
    return out.select("o_custkey", F.col("start_date").cast("string").alias("start_date"),
                      F.col("end_date").cast("string").alias("end_date"), "title")


@check("ded_8_title_hash", r"""SELECT doc_id, substr(sha1(regexp_replace(text, '\s+', '', 'g')), 1, 8) AS hash
FROM documents""")
def ded_8(spark, sf):
    # the SQL side has no NFKC; the texts are already in that form
    return texts(spark, sf, "documents").select("doc_id", identity.title_hash(F.col("text")).alias("hash"))


@check("ded_9_badges", """SELECT o_orderkey, o_orderstatus = 'P' OR coalesce(hit, false) AS sold_out FROM orders
LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS hit FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def ded_9(spark, sf):
    legs = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus = 'P' sold_out")
    cal = table(spark, sf, "lineitem").selectExpr("l_orderkey o_orderkey", "l_returnflag = 'R' sold_out")
    return identity.spread_badge(legs, cal, ["o_orderkey"], "sold_out")


# --- merge ------------------------------------------------------------------

#: stored rows are the listing before 1999; the batch is the listing from
#: 1997 on, some of it barer, some retitled, some newly sold out
_BATCH_SQL = "WITH " + STAGED_SQL + """, stored AS (SELECT * FROM staged WHERE start_date < DATE '1999-01-01'),
batch AS (
  SELECT * REPLACE (CASE WHEN k % 8 = 0 THEN title_ja || ' (new)' ELSE title_ja END AS title_ja,
    CASE WHEN k % 11 < 4 THEN NULL ELSE open_time END AS open_time,
    CASE WHEN k % 11 < 4 THEN NULL ELSE start_time END AS start_time,
    CASE WHEN k % 11 < 4 THEN NULL ELSE price_min END AS price_min,
    CASE WHEN k % 11 < 4 THEN [] ELSE link_urls END AS link_urls,
    k % 13 = 0 AS is_sold_out) FROM listing WHERE start_date >= DATE '1997-01-01'), joined AS (
  SELECT coalesce(b.id, s.id) AS id, b.id IS NOT NULL AS seen, s.id IS NOT NULL AS known,
    s.status AS old_status, s.first_day, s.last_day, s.updated_day, coalesce(b.source, s.source) AS source,
    CASE WHEN b.id IS NULL THEN s.title_ja ELSE b.title_ja END AS title_ja,
    coalesce(b.open_time, s.open_time) AS open_time, coalesce(b.start_time, s.start_time) AS start_time,
    coalesce(b.price_min, s.price_min) AS price_min,
    CASE WHEN coalesce(len(b.link_urls), 0) > 0 THEN b.link_urls ELSE coalesce(s.link_urls, []) END AS link_urls,
    coalesce(b.is_sold_out, false) OR coalesce(s.is_sold_out, false) AS is_sold_out,
    s.title_ja AS s_title, s.is_sold_out AS s_sold, s.open_time AS s_open, s.start_time AS s_start,
    s.price_min AS s_price, s.link_urls AS s_links
  FROM stored s FULL JOIN batch b ON s.id = b.id), judged AS (
  SELECT *, CASE WHEN NOT seen THEN NULL WHEN NOT known THEN 'new'
    WHEN title_ja = s_title AND is_sold_out = s_sold AND open_time IS NOT DISTINCT FROM s_open
     AND start_time IS NOT DISTINCT FROM s_start AND price_min IS NOT DISTINCT FROM s_price
     AND link_urls = s_links THEN 'unchanged' ELSE 'changed' END AS outcome FROM joined)"""


def stored_and_batch(spark, sf):
    stored = staged(spark, sf).filter("start_date < date'1999-01-01'")
    bare = "k % 11 < 4"
    fresh = listing(spark, sf).filter("start_date >= date'1997-01-01'") \
        .withColumn("title_ja", F.expr("case when k % 8 = 0 then concat(title_ja, ' (new)') else title_ja end")) \
        .withColumn("is_sold_out", F.expr("k % 13 = 0")) \
        .withColumn("ticket_links", F.when(F.expr(bare), F.array().cast("array<struct<provider:string,url:string,code:string>>"))
                    .otherwise(F.col("ticket_links")))
    for f in ("open_time", "start_time", "price_min"):
        fresh = fresh.withColumn(f, F.when(~F.expr(bare), F.col(f)))
    return stored, fresh


def merged(spark, sf):
    stored, fresh = stored_and_batch(spark, sf)
    default = F.when(F.col("source").startswith("hall"), "auto").otherwise("pending")
    return merge.merge_observations(stored, conform(fresh), now(), default)


@check("ups_1_upsert", _BATCH_SQL + """
SELECT id, outcome, title_ja, open_time, start_time, price_min, len(link_urls) AS n_links, is_sold_out FROM judged""")
def ups_1(spark, sf):
    return merged(spark, sf).select("id", "outcome", "title_ja", "open_time", "start_time", "price_min",
                                    F.size("ticket_links").alias("n_links"), "is_sold_out")


@check("ups_2_status", _BATCH_SQL + """
SELECT id, CASE WHEN outcome = 'new' THEN CASE WHEN source LIKE 'hall%' THEN 'auto' ELSE 'pending' END
  WHEN outcome = 'changed' AND old_status <> 'rejected' AND source NOT LIKE 'hall%' THEN 'pending'
  ELSE old_status END AS status FROM judged""")
def ups_2(spark, sf):
    return merged(spark, sf).select("id", "status")


@check("ups_3_timestamps", _BATCH_SQL + """, d AS (SELECT *, DATE '1998-06-01' AS t FROM judged)
SELECT id, CAST(CASE WHEN known THEN first_day ELSE t END AS VARCHAR) AS first_seen,
  CAST(CASE WHEN seen THEN t ELSE last_day END AS VARCHAR) AS last_seen,
  CAST(CASE WHEN outcome IN ('new', 'changed') THEN t ELSE updated_day END AS VARCHAR) AS updated_at FROM d""")
def ups_3(spark, sf):
    return merged(spark, sf).select("id", *[
        F.col(c).cast("date").cast("string").alias(c) for c in ("first_seen", "last_seen", "updated_at")])


@check("ups_4_approve", "WITH " + STAGED_SQL + """
SELECT id, CASE WHEN k % 100 < 3 THEN 'rejected' WHEN status = 'pending' AND source = 'hall_1' THEN 'approved'
  ELSE status END AS status, (status = 'pending' AND source = 'hall_1') AS approved FROM staged""")
def ups_4(spark, sf):
    rows = staged(spark, sf)
    ids = rows.filter("k % 100 < 3").select("id")
    done = merge.approve_pending(rows, now(), "hall_1")
    return merge.set_status(done, ids, "rejected", now()).select(
        "id", "status", F.col("_approved").alias("approved"))


@check("ups_5_attempts", """WITH a AS (SELECT o_orderkey AS event_id, 1 + o_orderkey % 3 AS attempts,
    o_orderstatus AS h FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'), f AS (
  SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'X' END AS h
  FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
SELECT coalesce(a.event_id, f.event_id) AS event_id, CASE WHEN f.event_id IS NULL THEN a.attempts
  WHEN a.h = f.h THEN a.attempts + 1 ELSE 1 END AS attempts, coalesce(f.h, a.h) AS content_hash
FROM a FULL JOIN f ON a.event_id = f.event_id""")
def ups_5(spark, sf):
    orders = table(spark, sf, "orders")
    attempts = orders.filter("o_orderdate < timestamp_ntz'1999-01-01'").selectExpr(
        "o_orderkey event_id", "cast(1 + o_orderkey % 3 as int) attempts", "o_orderstatus content_hash",
        "cast(null as timestamp) last_attempt")
    tried = orders.filter("o_orderdate >= timestamp_ntz'1997-01-01'").selectExpr(
        "o_orderkey event_id", "case when o_orderkey % 2 = 0 then o_orderstatus else 'X' end content_hash")
    return merge.note_attempts(attempts, tried, now()).drop("last_attempt")


@check("ups_6_prune", "WITH " + STAGED_SQL + """
SELECT id FROM staged WHERE coalesce(end_date, start_date) >= DATE '1998-06-01'""")
def ups_6(spark, sf):
    rows = staged(spark, sf)
    attempts = rows.select(F.col("id").alias("event_id"), F.lit(1).alias("attempts"))
    return merge.prune_attempts(attempts, rows, as_of()).select(F.col("event_id").alias("id"))


@check("ups_7_collapse", "WITH " + LISTING_SQL + """, o AS (SELECT *, CAST(start_date AS VARCHAR) || '/' || k AS pos FROM listing)
SELECT source, venue_name, arg_max(title_ja, pos) AS title_ja,
  arg_max(start_time, pos) FILTER (start_time IS NOT NULL) AS start_time,
  arg_max(price_min, pos) FILTER (price_min IS NOT NULL) AS price_min,
  arg_max(link_urls[1], pos) FILTER (len(link_urls) > 0) AS link, bool_or(is_sold_out) AS is_sold_out
FROM o GROUP BY source, venue_name""")
def ups_7(spark, sf):
    rows = listing(spark, sf)
    seen = rows.withColumn("at", F.concat(F.col("start_date").cast("string"), F.lit("/"), F.col("k").cast("string")))
    out = merge.collapse_batch(seen.drop("k", "id"), F.col("at"), ["source", "venue_name"])
    return out.select("source", "venue_name", "title_ja", "start_time", "price_min",
                      F.col("ticket_links")[0]["url"].alias("link"), "is_sold_out")


# --- venues -----------------------------------------------------------------


@check("jn_1_venue_norm", r"""SELECT s_suppkey, replace(lower(s_name), ' ', '') || 'hall' AS norm FROM supplier""")
def jn_1(spark, sf):
    from playbill.functions.text import venue_norm
    raw = F.expr("concat(translate(s_name, '0123456789', '０１２３４５６７８９'), '（旧 X） Ｈａｌｌ　(TOKYO)')")
    return table(spark, sf, "supplier").select("s_suppkey", venue_norm(raw).alias("norm"))


_RAW = ("case l_linenumber % 4 when 0 then s_name when 1 then concat(upper(s_name), '　ホールA') "
        "when 2 then concat(s_name, ' (TOKYO)') else concat('Unknown ', s_name) end")


@check("jn_2_venue_resolve", """SELECT l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN l_linenumber % 4 < 3 THEN 'v' || l_suppkey END AS venue_key FROM lineitem""")
def jn_2(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")) \
        .select("l_orderkey", "l_linenumber", "l_extendedprice", F.expr(_RAW).alias("raw"))
    reg = table(spark, sf, "supplier").selectExpr("cast(s_suppkey as int) ord", "concat('v', s_suppkey) venue_key",
                                                  "s_name display")
    return venues.resolve_venues(rows, "raw", venues.venue_index(reg)).drop("raw")


@check("jn_3_venue_facts", "WITH " + LISTING_SQL + """
SELECT k, 'Hall ' || venue_name[6:] AS display, CASE WHEN venue_name <> 'Hall 5'
  THEN 1000 * CAST(venue_name[6:] AS INT) END AS capacity FROM listing""")
def jn_3(spark, sf):
    reg = registry(spark, sf)
    rows = venues.resolve_venues(listing(spark, sf), "venue_name", venues.venue_index(reg))
    return venues.add_venue_facts(rows, reg).select("k", "display", "capacity")


def keyed(spark, sf):
    """The listing with venue keys; curated sources stand for seasonal ones."""
    return venues.assign_venue_key(listing(spark, sf), venues.venue_index(registry(spark, sf)), ["hall_5"], PROMOTERS)


@check("jn_4_venue_key", "WITH " + LISTING_SQL + """
SELECT k, source, 'hall_' || venue_name[6:] AS venue_key FROM listing""")
def jn_4(spark, sf):
    return keyed(spark, sf).select("k", "source", "venue_key")


@check("jn_4_venue_fallback", "WITH " + LISTING_SQL + """, r AS (
  SELECT k, source, CASE WHEN k % 5 = 2 THEN 'hall_1' WHEN k % 5 > 2 THEN 'hall_' || venue_name[6:] END AS resolved FROM listing)
SELECT k, source, CASE WHEN source = 'hall_5' THEN coalesce(resolved, source) WHEN source LIKE 'promo%' THEN resolved ELSE source END
  AS venue_key FROM r""")
def jn_4b(spark, sf):
    """Unknown and missing venue names: curated sources fall back to
    themselves, promoter rows have no key."""
    rows = listing(spark, sf).withColumn("venue_name", F.expr(
        "case k % 5 when 0 then 'Nowhere' when 1 then null when 2 then 'Hall 1' else venue_name end"))
    return venues.assign_venue_key(rows, venues.venue_index(registry(spark, sf)), ["hall_5"], PROMOTERS).select("k", "source", "venue_key")


@check("jn_5_match_key", r"""SELECT p_partkey, replace(p_name, ' ', '') || '~live' || lower(p_type) AS key FROM part""")
def jn_5(spark, sf):
    from playbill.functions.text import match_key
    raw = F.expr("concat('『', upper(p_name), '』（よみ）〜 Ｌｉｖｅ・', p_type, '(x)')")
    return table(spark, sf, "part").select("p_partkey", match_key(raw, artists.CURATED_ALIASES).alias("key"))


# --- overlap ----------------------------------------------------------------

_PARTS_SQL = "WITH " + LISTING_SQL + """, parts AS (
  SELECT DISTINCT k, source LIKE 'promo%' AS promo, start_date, 'hall_' || venue_name[6:] AS venue_key,
    replace(lower(p), ' ', '') AS part, t AS is_title FROM (
      SELECT *, unnest([title_ja, title_en]) AS p, true AS t FROM listing
      UNION ALL BY NAME SELECT *, unnest(lineup) AS p, false AS t FROM listing) WHERE p IS NOT NULL), overlap AS (
  SELECT DISTINCT a.k AS promo_k, b.k AS venue_k, a.start_date FROM parts a JOIN parts b
    ON a.promo AND NOT b.promo AND a.start_date = b.start_date AND a.venue_key = b.venue_key
   AND (contains(b.part, a.part) AND length(a.part) >= 3
     OR contains(a.part, b.part) AND length(b.part) >= CASE WHEN b.is_title THEN 4 ELSE 3 END))"""


def halves(spark, sf):
    rows = keyed_by_number(spark, sf)
    return (overlap.parts_of(rows.filter(F.col("source").isin(*PROMOTERS))),
            overlap.parts_of(rows.filter(~F.col("source").isin(*PROMOTERS))))


def keyed_by_number(spark, sf):
    rows = keyed(spark, sf)
    return rows.withColumn("id", F.col("k")).withColumn("ord", F.col("k"))


@check("jn_6_artist_overlap", _PARTS_SQL + """
SELECT DISTINCT promo_k FROM overlap""")
def jn_6(spark, sf):
    promo, venue = halves(spark, sf)
    return overlap.first_overlap(promo, venue).select(F.col("id").alias("promo_k"))


@check("jn_7_title_overlap", "WITH " + LISTING_SQL + """, t AS (
  SELECT k, start_date, venue_name, start_time, list_filter([title_ja, title_en], lambda x: x IS NOT NULL) AS ts FROM listing),
 p AS (SELECT a.start_date, a.venue_name, a.k AS x, b.k AS y FROM t a JOIN t b
  ON a.k < b.k AND a.start_date = b.start_date AND a.venue_name = b.venue_name
  AND len(list_filter(a.ts, lambda u: len(list_filter(b.ts, lambda w: contains(replace(lower(w), ' ', ''), replace(lower(u), ' ', ''))
    OR contains(replace(lower(u), ' ', ''), replace(lower(w), ' ', '')))) > 0)) > 0)
SELECT CAST(start_date AS VARCHAR) AS start_date, 'hall_' || venue_name[6:] AS venue_key, count(*) AS aligned
FROM p GROUP BY ALL""")
def jn_7(spark, sf):
    out = overlap.aligned_pairs(keyed(spark, sf))
    return out.filter("_aligned > 0").select(
        F.col("start_date").cast("string").alias("start_date"), "venue_key", F.col("_aligned").alias("aligned"))


@check("jn_8_first_fold", _PARTS_SQL + """
SELECT promo_k, min(venue_k) AS venue_k FROM overlap GROUP BY promo_k""")
def jn_8(spark, sf):
    promo, venue = halves(spark, sf)
    return overlap.first_overlap(promo, venue).select(
        F.col("id").alias("promo_k"), F.col("venue_id").alias("venue_k"))


@check("jn_9_merge_fold", _PARTS_SQL + """, f AS (
  SELECT promo_k, min(venue_k) AS venue_k FROM overlap GROUP BY promo_k), g AS (
  SELECT venue_k, bool_or(is_sold_out) AS sold, count(*) AS n, list(link_urls[1] ORDER BY promo_k) FILTER (len(link_urls) > 0) AS urls,
    arg_min(start_time, k) FILTER (start_time IS NOT NULL) AS start_time,
    arg_min(price_min, k) FILTER (price_min IS NOT NULL) AS price_min,
    arg_min(is_free, k) FILTER (is_free IS NOT NULL) AS is_free
  FROM f JOIN listing ON k = promo_k GROUP BY venue_k)
SELECT k, is_sold_out OR coalesce(sold, false) AS is_sold_out, coalesce(l.start_time, g.start_time) AS start_time,
  coalesce(l.price_min, g.price_min) AS price_min, coalesce(l.is_free, g.is_free) AS is_free,
  array_to_string(list_concat(link_urls, coalesce(list_filter(urls, lambda u: NOT list_contains(link_urls, u)), [])), ',') AS links,
  coalesce(n, 0) AS folded FROM listing l LEFT JOIN g ON k = venue_k WHERE source NOT LIKE 'promo%'""")
def jn_9(spark, sf):
    rows = keyed_by_number(spark, sf)
    promo = rows.filter(F.col("source").isin(*PROMOTERS))
    venue = rows.filter(~F.col("source").isin(*PROMOTERS))
    hits = overlap.first_overlap(overlap.parts_of(promo), overlap.parts_of(venue))
    folds = promo.join(hits.select("id", F.col("venue_id").alias("target_id")), "id")
    return overlap.fold_into(venue, folds).select(
        "k", "is_sold_out", "start_time", "price_min", "is_free", 
        F.array_join(F.transform("ticket_links", lambda t: t["url"]), ",").alias("links"), "folded")


def fold_sql(rows: str) -> str:
    """CTEs that fold the promoter rows named by the query ``rows`` (column k)
    in order of k: ``folded`` (k, home), home null for rows that stay."""
    return f""", open_rows AS ({rows}), look AS (
  SELECT p.*, l.source FROM parts p JOIN open_rows USING (k) JOIN listing l USING (k)), earlier AS (
  SELECT a.k, list(DISTINCT b.k) AS ov FROM look a JOIN look b
    ON a.start_date = b.start_date AND a.venue_key = b.venue_key AND b.k < a.k AND CASE WHEN a.source = b.source
      THEN a.is_title AND b.is_title AND (length(a.part) >= 4 AND contains(b.part, a.part)
        OR length(b.part) >= 4 AND contains(a.part, b.part))
      ELSE length(a.part) >= 3 AND contains(b.part, a.part)
        OR length(b.part) >= CASE WHEN b.is_title THEN 4 ELSE 3 END AND contains(a.part, b.part) END GROUP BY a.k), turn AS (
  SELECT k, start_time AS t, coalesce(ov, []) AS ov, start_date || venue_name AS g,
    row_number() OVER (PARTITION BY start_date, venue_name ORDER BY k) AS n
  FROM listing JOIN open_rows USING (k) LEFT JOIN earlier USING (k)), folded AS (
  SELECT g, 0::BIGINT AS n, CAST([] AS STRUCT(k BIGINT, t VARCHAR)[]) AS kept, NULL::BIGINT AS k, NULL::BIGINT AS home
  FROM (SELECT DISTINCT g FROM turn)
  UNION ALL SELECT g, n, CASE WHEN home IS NULL THEN list_append(kept, {{'k': k, 't': t}}) ELSE list_transform(kept, lambda x:
      CASE WHEN x.k = home THEN {{'k': x.k, 't': coalesce(x.t, t)}} ELSE x END) END, k, home FROM (
    SELECT r.g, r.n, f.kept, r.k, r.t, list_filter(f.kept, lambda x: list_contains(r.ov, x.k)
      AND (x.t IS NULL OR r.t IS NULL OR x.t = r.t))[1].k AS home FROM folded f JOIN turn r ON r.g = f.g AND r.n = f.n + 1))"""


_RECURSIVE_PARTS = _PARTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


@check("jn_10_promoter_fold", _RECURSIVE_PARTS + fold_sql("SELECT k FROM listing WHERE source LIKE 'promo%'") + """
SELECT k AS id, home AS target_id FROM folded WHERE home IS NOT NULL""")
def jn_10(spark, sf):
    rows = keyed_by_number(spark, sf).filter(F.col("source").isin(*PROMOTERS))
    return overlap.fold_promoters(rows).select("id", "target_id")


#: festivals stand-in: every part type is a festival on the days of its
#: orders, at the hall of the order
_FEST_SQL = "WITH " + LISTING_SQL + """, fest AS (
  SELECT DISTINCT lower(p_type) AS name, 'f_' || p_type AS venue_key, CAST(o_orderdate AS DATE) + i AS day
  FROM orders JOIN part ON o_custkey = p_partkey, (SELECT unnest([0, 1]) AS i))"""


def festival_rows(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "part"), F.col("o_custkey") == F.col("p_partkey")) \
        .selectExpr(
            "o_orderkey id", "o_orderkey ord", "concat('f_', p_type) venue_key", "concat(p_type, ' (TOKYO)') venue_name",
            "cast(o_orderdate as date) start_date", "date_add(cast(o_orderdate as date), 1) end_date")


def festival_hosts(spark, sf):
    return table(spark, sf, "part").selectExpr("concat('f_', p_type) festival_key").distinct() \
        .withColumn("host_key", F.expr("concat('hall_', 1 + length(festival_key) % 5)"))


@check("jn_11_festival_days", _FEST_SQL + """
SELECT venue_key, name, CAST(day AS VARCHAR) AS day FROM fest""")
def jn_11(spark, sf):
    return overlap.festival_days(festival_rows(spark, sf)).select(
        "venue_key", "name", F.col("day").cast("string").alias("day"))


@check("jn_12_festival_duplicates", _FEST_SQL + """
SELECT DISTINCT k FROM listing JOIN fest ON start_date = day AND contains(lower(title_ja), name)
WHERE source LIKE 'promo%' OR 'hall_' || venue_name[6:] = 'hall_' || (1 + length(venue_key) % 5)""")
def jn_12(spark, sf):
    out = overlap.festival_duplicates(keyed_by_number(spark, sf), overlap.festival_days(festival_rows(spark, sf)),
                                      festival_hosts(spark, sf), PROMOTERS)
    return out.select(F.col("id").alias("k"))


# --- artists ----------------------------------------------------------------


def part_aliases(spark, sf):
    """Alias table out of the data: a colour word's act goes by its size."""
    return table(spark, sf, "part").filter("p_name like 'old %'").selectExpr(
        "p_name alias_key", "concat('Classic ', split(p_name, ' ')[1]) spelling").distinct()


@check("jn_13_spelling", """SELECT p_partkey, CASE WHEN p_name LIKE 'old %' THEN 'Classic ' || split_part(p_name, ' ', 2)
  ELSE upper(p_name) END AS spelling FROM part""")
def jn_13(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", "upper(p_name) name")
    return artists.spell_canonically(rows, "name", part_aliases(spark, sf)).select("p_partkey", "spelling")


_ARTIST_SQL = "WITH " + LISTING_SQL + """, named AS (
  SELECT id, name, lower(name) AS key FROM (SELECT id, unnest(lineup) AS name FROM listing) WHERE length(name) >= 2),
 texts AS (SELECT DISTINCT hay FROM (SELECT trim(lower(title_ja || ' ' || coalesce(title_en, ''))) AS hay FROM listing
   WHERE category IN ('music', 'music_festival'))),
 spans AS (SELECT hay, key, strpos(' ' || hay || ' ', ' ' || key || ' ') AS s, length(key) AS n FROM texts,
   (SELECT DISTINCT key FROM named WHERE length(key) >= 4) WHERE contains(' ' || hay || ' ', ' ' || key || ' ')),
 longest AS (SELECT * FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.hay = a.hay AND b.n > a.n
   AND b.s <= a.s AND a.s + a.n <= b.s + b.n))"""


@check("jn_14_title_names", _ARTIST_SQL + " SELECT hay, key AS name FROM longest")
def jn_14(spark, sf):
    rows = listing(spark, sf)
    keys = artists.lineup_names(rows, artists.alias_table(spark)).select(F.col("key").alias("match_key")).distinct() \
        .withColumn("link_key", F.col("match_key"))
    music = rows.filter(F.col("category").isin("music", "music_festival")).select(artists.title_text().alias("hay"))
    return artists.find_names(music, keys).select("hay", F.col("match_key").alias("name"))


@check("jn_15_longest_span", """WITH s AS (SELECT DISTINCT o_custkey AS hay, o_orderkey % 97 AS x,
    o_orderkey % 97 + 3 + o_orderkey % 20 AS y FROM orders)
SELECT hay, x AS span_from, y AS span_to FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.hay = b.hay AND b.x <= a.x
  AND a.y <= b.y AND b.y - b.x > a.y - a.x)""")
def jn_15(spark, sf):
    spans = table(spark, sf, "orders").selectExpr(
        "o_custkey hay", "o_orderkey % 97 at", "o_orderkey % 97 + 3 + o_orderkey % 20 until").distinct() \
        .withColumn("needle", F.lit(""))
    return artists.longest_spans(spans).select("hay", F.col("at").alias("span_from"), F.col("until").alias("span_to"))


@check("agg_3_display_name", """WITH v AS (
  SELECT lang AS key, source || repeat('.', CAST(quality AS INT)) AS name, doc_id FROM documents JOIN labels USING (doc_id)),
 c AS (SELECT key, name, count(*) AS n, min(doc_id) AS first FROM v GROUP BY ALL)
SELECT key, arg_min(name, (-n, length(name), first)) AS name FROM c GROUP BY key""")
def agg_3(spark, sf):
    votes = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").selectExpr(
        "lang key", "concat(source, repeat('.', cast(quality as int))) name", "doc_id id", "0 pos")
    return artists.display_names(votes)


def index(spark, sf):
    return artists.build_artist_index(listing(spark, sf), artists.alias_table(spark))


@check("agg_4_event_artists", _ARTIST_SQL + """
SELECT DISTINCT id, key AS artist_key FROM named UNION
SELECT id, key FROM longest JOIN listing ON hay = trim(lower(title_ja || ' ' || coalesce(title_en, '')))
WHERE category IN ('music', 'music_festival')""")
def agg_4(spark, sf):
    return index(spark, sf)["event_artists"]


@check("agg_4_aliases", "WITH " + LISTING_SQL + """
SELECT DISTINCT lower(name) AS norm_key, name AS alias, lower(name) AS artist_key
FROM (SELECT unnest(lineup) AS name FROM listing)""")
def agg_4b(spark, sf):
    return index(spark, sf)["artist_aliases"]


@check("agg_5_artists_per_event", _ARTIST_SQL + """, links AS (
  SELECT DISTINCT id, key FROM named UNION
  SELECT id, key FROM longest JOIN listing ON hay = trim(lower(title_ja || ' ' || coalesce(title_en, '')))
  WHERE category IN ('music', 'music_festival')), names AS (SELECT key, min(name) AS name FROM named GROUP BY key)
SELECT listing.id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS artists
FROM listing LEFT JOIN links USING (id) LEFT JOIN names USING (key) GROUP BY listing.id""")
def agg_5(spark, sf):
    rows = listing(spark, sf)
    return artists.attach_artists(rows, index(spark, sf)).select("id", F.array_join("artists", ",").alias("artists"))


@check("cls_8_clean_artist", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_name
  WHEN 2 THEN NULL ELSE p_type END AS artist FROM part""")
def cls_8(spark, sf):
    from playbill.functions.names import clean_artist
    raw = F.expr("case p_partkey % 4 when 0 then concat('ゲスト：', p_brand) when 1 then concat(' ・', p_name, '／') "
                 "when 2 then 'and more…' else concat('w/ ', p_type) end")
    return table(spark, sf, "part").select("p_partkey", clean_artist(raw).alias("artist"))


@check("cls_9_billing_guard", """SELECT doc_id AS id, count(*) AS names FROM (
  SELECT doc_id, text AS title, unnest([text, source, lang || ' band']) AS name FROM documents)
WHERE length(trim(name)) BETWEEN 2 AND 80 AND NOT (trim(name, ' ・/|,') = trim(title) AND length(trim(title)) >= 20) GROUP BY doc_id""")
def cls_9(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id id", "text title_ja", "cast(null as string) title_en", "array(text, source, concat(lang, ' band')) lineup")
    return artists.lineup_names(rows, artists.alias_table(spark)).groupBy("id").agg(F.count(F.lit(1)).alias("names"))


@check("jn_20_duplicate_groups", _PARTS_SQL.replace(_PARTS_SQL[_PARTS_SQL.index(", overlap AS"):], "") + """, g AS (
  SELECT start_date, venue_name, count(*) AS rows, count(DISTINCT source) AS n_src, bool_or(source LIKE 'promo%') AS p,
    count(start_time) AS timed, count(DISTINCT start_time) AS times FROM listing GROUP BY ALL), pr AS (
  SELECT DISTINCT a.k AS x, b.k AS y, a.start_date, a.venue_key FROM parts a JOIN parts b ON a.k < b.k AND a.is_title AND b.is_title
    AND a.start_date = b.start_date AND a.venue_key = b.venue_key AND (contains(a.part, b.part) OR contains(b.part, a.part))),
 al AS (SELECT start_date, venue_key, count(*) AS aligned FROM pr GROUP BY ALL)
SELECT CAST(g.start_date AS VARCHAR) AS start_date, 'hall_' || venue_name[6:] AS venue_key, rows,
  CASE WHEN n_src > 1 THEN 'cross-source' WHEN coalesce(aligned, 0) = rows * (rows - 1) / 2 AND timed = rows AND times = rows
    THEN 'performances' WHEN coalesce(aligned, 0) = 0 THEN 'distinct' ELSE 'unexplained' END AS class
FROM g LEFT JOIN al ON al.start_date = g.start_date AND al.venue_key = 'hall_' || venue_name[6:] WHERE rows > 1 AND p""")
def jn_20(spark, sf):
    return overlap.duplicate_groups(keyed(spark, sf), PROMOTERS).select(
        F.col("start_date").cast("string").alias("start_date"), "venue_key", "rows", "class")


@check("set_2_link_union", """SELECT a.o_orderkey AS k, CASE WHEN a.o_orderkey % 2 = 0 THEN 'u' || a.o_custkey || ',' ELSE '' END
  || 'p' || CASE WHEN a.o_orderkey % 2 = 0 THEN '' ELSE ',u' || a.o_custkey END AS urls FROM orders a""")
def set_2(spark, sf):
    link = "named_struct('provider', 'x', 'url', {}, 'code', cast(null as string))"
    own, promo, none = (link.format(u) for u in ("concat('u', o_custkey)", "'p'", "cast(null as string)"))
    mine = F.expr(f"case when o_orderkey % 2 = 0 then array({own}, {promo}) else array({promo}) end")
    theirs = F.expr(f"array({promo}, {none}, {own}, {own})")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(F.transform(
        select.union_links(mine, theirs), lambda t: t["url"]), ",").alias("urls"))



"""Text to facts.

Notices are written out from the columns of ``orders`` in the layouts the
extractors know, and read back; the SQL side computes the expected values
from the columns and never sees the text.  Page operators run on ``pages``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import LISTING_SQL, check, listing, table, texts
from playbill.functions import dates, flags, names, prices, times, urls
from playbill.operators import enrich, pages, policies
from playbill.session import cut_lineage
from playbill.sources.pages import month_tabs

#: shared columns of a notice: k, c, opening and start clock, two prices, day
_DAY = "cast(o_orderdate as date) + 10957"
NOTICE_SQL = """n AS (
  SELECT o_orderkey AS k, CAST(o_custkey AS INT) AS c, 15 + o_custkey % 5 AS h, (o_custkey % 4) * 15 AS m,
         1000 + CAST(floor(o_totalprice / 100) AS INT) AS p, CAST(o_orderdate AS DATE) + 10957 AS d,
         lpad(CAST(15 + o_custkey % 5 AS VARCHAR), 2, '0') || ':' ||
           lpad(CAST((o_custkey % 4) * 15 AS VARCHAR), 2, '0') AS opening,
         lpad(CAST(16 + o_custkey % 5 AS VARCHAR), 2, '0') || ':' ||
           lpad(CAST((o_custkey % 4) * 15 AS VARCHAR), 2, '0') AS start
  FROM orders)"""


def notices(spark, sf):
    return texts(spark, sf, "orders").selectExpr(
        "o_orderkey k", "cast(o_custkey as int) c", "cast(15 + o_custkey % 5 as int) h",
        "cast((o_custkey % 4) * 15 as int) m", "1000 + cast(floor(o_totalprice / 100) as int) p",
        f"date_add(cast(o_orderdate as date), 10957) d") \
        .withColumn("opening", F.format_string("%02d:%02d", "h", "m")) \
        .withColumn("start", F.format_string("%02d:%02d", F.col("h") + 1, "m"))


def noted(spark, sf, *layouts: str, by: str = "c"):
    """Notices with ``text``: the layout is chosen by the customer number."""
    cases = " ".join(f"when {i} then {expr}" for i, expr in enumerate(layouts))
    return notices(spark, sf).withColumn("text", F.expr(f"case {by} % {len(layouts)} {cases} end"))


@check("ext_5_open_start", f"""WITH {NOTICE_SQL}
SELECT k, CASE WHEN c % 3 = 2 THEN start ELSE opening END AS open_time, start AS start_time FROM n""")
def ext_5(spark, sf):
    rows = noted(spark, sf, "concat('OPEN ', opening, ' START ', start)",
                 "concat('[OPEN] ', opening, '　[START] ', start)",
                 "concat('会場 OPEN / START ', start, ' / 終演未定')")
    opening, start = times.open_start(F.col("text"))
    return rows.select("k", opening.alias("open_time"), start.alias("start_time"))


@check("ext_6_time_variants", f"""WITH {NOTICE_SQL}
SELECT k, CASE WHEN c % 4 = 3 THEN NULL ELSE opening END AS open_time, start AS start_time FROM n""")
def ext_6(spark, sf):
    rows = noted(
        spark, sf,
        "concat('open ', h - 12, substring(opening, 3, 3), 'pm start ', h - 11, substring(start, 3, 3), 'pm')",
        "concat(opening, ' / ', start, ' 2部 19:00 / 20:00')",
        "concat('開場', h, '時', m, '分 開演', h + 1, '時', m, '分')",
        "concat('TIP OFF ', start)")
    opening, start = times.time_variants(F.col("text"))
    return rows.select("k", opening.alias("open_time"), start.alias("start_time"))


@check("ext_7_labelled_times", f"""WITH {NOTICE_SQL}
SELECT k, opening AS open_time, start AS start_time FROM n""")
def ext_7(spark, sf):
    rows = noted(spark, sf, "concat('開場', opening, '／開演', start)",
                 "concat(opening, '開場／', start, '開演')")
    opening, start = times.labelled_times(F.col("text"))
    return rows.select("k", opening.alias("open_time"), start.alias("start_time"))


@check("ext_8_doors_from_note", f"""WITH {NOTICE_SQL}, g AS (
  SELECT k, (h + 1) * 60 + m - (10 + (c % 6) * 10) AS t FROM n)
SELECT k, lpad(CAST(t // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0')
  AS open_time FROM g""")
def ext_8(spark, sf):
    rows = noted(spark, sf, "concat('開場は開演の', 10 + (c % 6) * 10, '分前です')")
    return rows.select("k", times.doors_from_note(F.col("text"), F.col("start")).alias("open_time"))


@check("ext_9_price_floor", f"""WITH {NOTICE_SQL}
SELECT k, CASE WHEN c % 3 = 2 THEN 0 ELSE p END AS price_min, c % 3 = 2 AS is_free FROM n""")
def ext_9(spark, sf):
    rows = noted(
        spark, sf,
        "concat('前売 ￥', format_number(p, 0), ' 当日 ￥', format_number(p + 500, 0), ' ※学生500円引')",
        "concat('前売 ', p, '円　当日 ', format_number(p + 500, 0), '円 ロッカー100円')",
        "'入場 ¥0 (ドリンク注文制)'")
    price = prices.price_floor(F.col("text"))
    return rows.select("k", price["price_min"].alias("price_min"), price["is_free"].alias("is_free"))


@check("ext_10_drink_charges", f"WITH {NOTICE_SQL} SELECT k, p AS price_min FROM n")
def ext_10(spark, sf):
    rows = noted(spark, sf, "concat('ADV ¥', p, ' (ドリンク代別途¥600)')",
                 "concat('ADV ¥', p, ' +1DRINK ¥600')", "concat('ADV ¥', p, ' D代600円')")
    return rows.select("k", prices.price_floor(
        prices.without_drink_charges(F.col("text")))["price_min"].alias("price_min"))


@check("ext_11_price_policies", f"""WITH {NOTICE_SQL}
SELECT k, p AS leading, p + 100 AS tax_included, p AS zone, p AS keyword_lines, p AS backslash_yen,
       p AS bare_digits, p + 500 AS headline FROM n""")
def ext_11(spark, sf):
    layouts = {
        "leading": "concat('S席 ¥', p, ' (+グッズ ¥500)\nA席 ¥', p + 900)",
        "tax_included": "concat('前売 ¥', p + 100, '(税込) 本体 ¥', p)",
        "zone": "concat('パンフ 500円 料金 ', p, '円 主催 X 300円')",
        "keyword_lines": "concat('物販 ¥500\nADV ¥', p, '\n※ ADV ¥100')",
        "backslash_yen": "concat('入場 \\\\', p, ' ')",
        "bare_digits": "concat('2026 PRICE: ', p, ' / ', p + 500, '\n1000 seats')",
        "headline": "concat('特別席 ¥', p + 500, ' 一般 ¥', p)",
    }
    rows = notices(spark, sf)
    return rows.select("k", *[
        prices.price_by_policy(F.expr(text), prices.POLICIES[name])["price_min"].alias(name)
        for name, text in layouts.items()])


@check("ext_12_admission", f"""WITH {NOTICE_SQL}
SELECT k, CASE c % 4 WHEN 0 THEN p WHEN 1 THEN p + 500 WHEN 2 THEN p END AS price_min,
       CASE c % 4 WHEN 3 THEN true END AS is_free FROM n""")
def ext_12(spark, sf):
    rows = noted(
        spark, sf,
        "concat('開館 10時 入館料 一般 ', format_number(p, 0), '円 大学生 ', p - 200, '円 中学生以下 無料')",
        "concat('観覧料 前売 ', p, '円（一般） 当日 ', p + 500, '円（一般）')",
        "concat('入場料 ', p, '円 図録 2500円')",
        "'会期中無休 入場無料'")
    return prices.with_admission(rows, "text").selectExpr(
        "k", "admission.price_min price_min", "admission.is_free is_free")


@check("ext_13_sold_out", f"""WITH {NOTICE_SQL}
SELECT k, c % 5 IN (0, 1, 3) AS announced, c % 5 IN (1, 4) AS by_seats FROM n""")
def ext_13(spark, sf):
    rows = noted(spark, sf, "'Sold  Out'", "'完売御礼 ××'", "'×：予定枚数終了 ◎：余裕'",
                 "'予定枚数終了いたしました'", "'× 受付終了'")
    return rows.select("k", flags.is_sold_out(F.col("text")).alias("announced"),
                       flags.sold_out_by_seats(F.col("text")).alias("by_seats"))


@check("ext_14_status_tags", f"""WITH {NOTICE_SQL}
SELECT k, CASE c % 4 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'postponed,streaming'
         WHEN 2 THEN '2-stages,dark-days' ELSE '' END AS tags,
       CASE c % 4 WHEN 1 THEN 'Show ' || k || ' 配信' WHEN 2 THEN 'Show 2nd Stage 休演日 ' || k
         ELSE 'Show ' || k END AS title FROM n""")
def ext_14(spark, sf):
    rows = noted(spark, sf, "concat('【公演中止】Show ', k)", "concat('(延期) Show ', k, ' 配信')",
                 "concat('Show 2nd Stage 休演日 ', k)", "concat('Show ', k)")
    return rows.select("k", F.array_join(flags.status_tags(F.col("text")), ",").alias("tags"),
                       flags.without_status_mark(F.col("text")).alias("title"))


_FORWARD = """list_filter([try_cast((year({a}) + s) || '-' || lpad(CAST(month(d) AS VARCHAR), 2, '0')
   || '-' || lpad(CAST(day(d) AS VARCHAR), 2, '0') AS DATE) FOR s IN [-1, 0, 1]],
   lambda x: x - {a} BETWEEN -60 AND 320)[1]"""


@check("ext_15_text_date", f"""WITH {NOTICE_SQL}
SELECT k, CAST(CASE WHEN c % 3 < 2 THEN d ELSE {_FORWARD.format(a="DATE '2028-02-01'")} END AS VARCHAR)
  AS start_date FROM n""")
def ext_15(spark, sf):
    rows = noted(spark, sf, "concat(date_format(d, 'yyyy.M.d'), ' (土) 19:00')",
                 "concat('日時 ', date_format(d, 'yyyy年M月d日'))",
                 "concat(date_format(d, 'M.d'), '(sat) LIVE')")
    as_of = F.lit("2028-02-01").cast("date")
    return rows.select("k", dates.text_date(F.col("text"), as_of).cast("string").alias("start_date"))


@check("ext_16_forward_year", f"""WITH {NOTICE_SQL}, a AS (SELECT *, d + c % 500 - 350 AS a FROM n)
SELECT k, CAST({_FORWARD.format(a="a")} AS VARCHAR) AS start_date FROM a""")
def ext_16(spark, sf):
    rows = notices(spark, sf).withColumn("a", F.expr("date_add(d, c % 500 - 350)"))
    return rows.select("k", dates.forward_year(F.month("d"), F.dayofmonth("d"), F.col("a"))
                       .cast("string").alias("start_date"))


@check("ext_17_nearest_year", f"WITH {NOTICE_SQL} SELECT k, CAST(d AS VARCHAR) AS start_date FROM n")
def ext_17(spark, sf):
    rows = notices(spark, sf).withColumn("a", F.expr("date_add(d, c % 300 - 150)"))
    return rows.select("k", dates.nearest_year(F.month("d"), F.dayofmonth("d"), F.col("a"))
                       .cast("string").alias("start_date"))


@check("ext_18_page_year", f"""WITH {NOTICE_SQL}
SELECT k, CAST(d AS VARCHAR) AS by_header, year(d + 240) AS by_rollover FROM n""")
def ext_18(spark, sf):
    rows = notices(spark, sf).withColumn("h", F.expr("add_months(trunc(d, 'MM'), c % 9 - 4)"))
    months = F.array(*[F.month(F.date_add("d", 40 * i)) for i in range(7)])
    return rows.select(
        "k", dates.header_year(F.month("d"), F.dayofmonth("d"), F.year("h"), F.month("h"))
        .cast("string").alias("by_header"),
        F.element_at(dates.rollover_years(months, F.year("d")), -1).alias("by_rollover"))


@check("ext_18_month_tabs", """WITH o AS (SELECT o_orderkey, o_custkey, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders),
 t AS (SELECT o_custkey, m, min(y) AS y FROM o GROUP BY ALL)
SELECT o_orderkey, t.y AS year FROM o JOIN t USING (o_custkey, m)""")
def ext_18b(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.month("o_orderdate").alias("month"),
                                             F.year("o_orderdate").alias("_y"))
    tabs = rows.groupBy("o_custkey", "month").agg(F.min("_y").alias("year"))
    return month_tabs(rows.drop("_y"), tabs, "o_custkey").select("o_orderkey", "year")


@check("ext_19_date_range", f"""WITH {NOTICE_SQL}, r AS (SELECT *, d + c % 200 AS e FROM n), ok AS (
  SELECT *, NOT (c % 4 < 3 AND month(e) = 2 AND day(e) = 29 AND year(e) <> year(d)) AS fine FROM r)
SELECT k, CASE WHEN fine THEN CAST(d AS VARCHAR) END AS start_date,
       CASE WHEN fine THEN CAST(e AS VARCHAR) END AS end_date FROM ok""")
def ext_19(spark, sf):
    rows = notices(spark, sf).withColumn("e", F.expr("date_add(d, c % 200)")).withColumn("text", F.expr(
        """case c % 4 when 0 then concat(date_format(d, 'yyyy年M月d日'), '（土）〜', date_format(e, 'M月d日'))
           when 1 then concat('会期 ', date_format(d, 'yyyy.M.d'), ' - ', date_format(e, 'M.d'))
           when 2 then concat('会期 ', date_format(d, 'yyyy/M/d'), ' - ', date_format(e, 'M/d'))
           else concat('<time datetime="', d, '">x</time>～<time datetime="', e, '">y</time>') end"""))
    run = dates.any_range(F.col("text"), F.col("text"))
    return rows.select("k", run["start"].cast("string").alias("start_date"),
                       run["end"].cast("string").alias("end_date"))


@check("ext_20_multi_day", """SELECT l_orderkey AS k, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS start_date,
  CAST(CASE WHEN max(l_shipdate) <> min(l_shipdate) THEN CAST(max(l_shipdate) AS DATE) END AS VARCHAR) AS end_date
FROM lineitem GROUP BY l_orderkey""")
def ext_20(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array(F.min("l_shipdate"), F.max("l_shipdate")).alias("_d"))
    span = dates.span_of(F.transform("_d", lambda d: d.cast("date")))
    return rows.select("k", span["start"].cast("string").alias("start_date"),
                       span["end"].cast("string").alias("end_date"))


@check("ext_21_ticket_links", f"""WITH {NOTICE_SQL}
SELECT k, CASE c % 3 WHEN 0 THEN 'eplus|https://eplus.jp/act' || c || ';pia|P123-' || 100 + c % 900
  WHEN 1 THEN 'pia|https://t.pia.jp/pia/event.do?e=' || k || ';lawson|L7' || 1000 + c % 9000
  ELSE '' END AS links FROM n""")
def ext_21(spark, sf):
    rows = noted(
        spark, sf,
        "concat('<a href=\"https://eplus.jp/sf/\">e+</a><a href=\"/act\">home</a>"
        "<a href=\"https://eplus.jp/act', c, '\">buy</a><a href=\"https://eplus.jp/act', c, '\">buy</a>"
        " Pコード：123-', 100 + c % 900)",
        "concat('<a href=\"https://t.pia.jp/pia/event.do?e=', k, '\">pia</a>"
        "<a href=\"https://t.pia.jp/info/privacy.jsp\">privacy</a> Lコード:7', 1000 + c % 9000)",
        "concat('<a href=\"http://eplus.jp/\">top</a><a href=\"https://support.eplus.jp/x\">help</a>')")
    page = rows.select("k", F.lit("https://hall.example/e/").alias("url"), F.col("text").alias("html"))
    found = pages.links(page, "k")
    body = page.select("k", pages.visible_text(F.col("html")).alias("text"))
    shown = F.transform("ticket_links", lambda t: F.concat_ws(
        "|", t["provider"], F.coalesce(t["url"], t["code"])))
    return pages.ticket_links(found, body, "k").select("k", F.array_join(shown, ";").alias("links"))


@check("ext_22_provider_slug", """WITH h AS (
  SELECT page_id, list_filter(string_split(regexp_extract(url, 'https?://([^/]+)', 1), '.'),
         lambda x: x NOT IN ('www', 'info', 'ticket', 'tickets')) AS parts FROM pages), s AS (
  SELECT page_id, parts, list_filter(parts, lambda x: x NOT IN ('co', 'or', 'ne', 'ac', 'go', 'ad', 'ed', 'gr',
         'lg', 'com', 'net', 'org', 'jp', 'io')) AS naming FROM h)
SELECT page_id, coalesce(naming[-1], parts[1], 'vendor') AS provider FROM s""")
def ext_22(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", urls.provider_slug(F.col("url")).alias("provider"))


@check("ext_23_modal_links", """SELECT p_partkey AS page_id, 'm' || i AS target,
  'https://eplus.jp/' || p_partkey || '-' || i AS href FROM part, (SELECT unnest([0, 1]) AS i)""")
def ext_23(spark, sf):
    page = texts(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"), F.expr(
            "concat('<div><button data-modal-target=\"m0\">詳細</button><button data-modal-target=\"m1\">詳細"
            "</button><a href=\"/x\">x</a></div><div data-modal-id=\"m0\"><p>e+ <a href=\"https://eplus.jp/', "
            "p_partkey, '-0\">', p_name, '</a></div><div data-modal-id=\"m1\"><a href=\"https://eplus.jp/', "
            "p_partkey, '-1\">buy</a></div><div data-modal-id=\"m2\"><a href=\"/never\">n</a></div>')").alias("html"))
    return pages.modal_links(pages.elements(page)).select("page_id", "target", "href")


@check("ext_24_title_split", """SELECT p_partkey AS k, p_name AS title, p_type AS rest,
  CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_brand END AS best FROM part""")
def ext_24(spark, sf):
    title, rest = names.split_repeated(F.expr("concat(p_name, p_name, ' - ', p_type)"))
    best = names.best_title(
        F.expr("case when p_partkey % 3 = 0 then concat(' ', p_name, ' ') end"),
        F.expr("case when p_partkey % 3 = 1 then concat('OPEN 「', p_type, '」') "
               "else concat(p_brand, ' OPEN 18:00') end"), "OPEN")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), title.alias("title"), rest.alias("rest"), best.alias("best"))


@check("ext_25_lineup_split", """SELECT p_partkey AS k, p_brand || ',' || p_name || ',' || p_type AS lineup FROM part""")
def ext_25(spark, sf):
    bill = F.expr("concat(p_brand, ' / ゲスト：', p_name, '／TBA／', p_brand, '\nhttps://x.example\n', p_type)")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), F.array_join(names.split_lineup(bill), ",").alias("lineup"))


@check("ext_25_policies", """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name || ',' || p_type || ',' || p_brand
  WHEN 1 THEN p_name || ',' || p_type || ' / ' || p_brand WHEN 2 THEN p_name || ',' || p_type || ',' || p_brand END AS lineup FROM part""")
def ext_25b(spark, sf):
    """Three layouts of a bill; a table says which source prints which."""
    bill = F.expr(
        "case p_partkey % 4 when 0 then concat('【出演】', p_name, ' / GUEST：', p_type, '\nOPEN 18:00\n※ 変更あり\n', p_brand, '\n', "
        "p_name, '／', repeat('x', 41)) when 1 then concat('出演者：', p_name, '\nGUEST\nhttps://x.example\n・', p_type, ' / ', p_brand, "
        "'\n', p_name, '\n後日発表') else concat(p_name, '【ゲスト】／', p_type, '、', p_brand, ',', p_name, '\n※ 予定') end")
    chosen = spark.createDataFrame([("s0", "card_body"), ("s1", "lines_only"), ("s2", "headliner")], "source string, policy string")
    compiled = {name: names.split_lineup(F.col("bill"), policy) for name, policy in (
        ("card_body", names.CARD_BODY), ("lines_only", names.LINES_ONLY), ("headliner", names.HEADLINER))}
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr("concat('s', p_partkey % 4)").alias("source"), bill.alias("bill"))
    return policies.by_policy(rows, chosen, compiled, "lineup").select("k", F.array_join("lineup", ",").alias("lineup"))


@check("ext_26_title_guard", """SELECT p_partkey AS k,
  CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS lineup FROM part""")
def ext_26(spark, sf):
    title = F.expr("concat(p_name, case p_partkey % 3 when 1 then ' Tour 2026' when 2 then ' × X' else '' end)")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), F.array_join(flags.title_as_lineup(title), ",").alias("lineup"))


@check("ext_27_bills", """WITH a AS (
  SELECT o_custkey AS edition, CAST(o_orderkey % 3 AS INT) AS col, upper(o_orderpriority) AS name,
         min(o_orderkey) AS pos FROM orders GROUP BY ALL), b AS (
  SELECT edition, DATE '2026-07-01' + CAST(edition % 300 AS INT) + col AS day,
         string_agg(name, ',' ORDER BY pos) AS lineup FROM a GROUP BY ALL)
SELECT how, edition, CAST(day AS VARCHAR) AS day, lineup FROM b, (SELECT unnest(['code', 'column']) AS how)""")
def ext_27(spark, sf):
    orders = table(spark, sf, "orders")
    first = F.expr("date_add(date'2026-07-01', cast(edition % 300 as int))")
    editions = orders.select(F.col("o_custkey").alias("edition")).distinct() \
        .withColumn("dates", F.array(*[F.date_add(first, i) for i in range(3)]))
    acts = orders.selectExpr("o_custkey edition", "cast(o_orderkey % 3 as int) col", "o_orderkey pos",
                             "upper(o_orderpriority) name")
    coded = acts.join(editions, "edition").selectExpr(
        "edition", "date_format(dates[col], 'MMdd') code", "pos", "name")
    bills = enrich.bill_by_column(editions, acts).withColumn("how", F.lit("column")).unionByName(
        enrich.bill_by_code(editions, coded).withColumn("how", F.lit("code")))
    return bills.select("how", "edition", F.col("day").cast("string").alias("day"),
                        F.array_join("lineup", ",").alias("lineup"))


@check("ext_28_mirror", """SELECT p_partkey AS k, p_name AS title_ja,
  CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN NULL ELSE NULL END AS title_en FROM part""")
def ext_28(spark, sf):
    part = table(spark, sf, "part")
    mirror = part.filter("p_partkey % 3 <> 2").selectExpr(
        "p_brand brand", "p_partkey k", "case when p_partkey % 3 = 0 then p_type else p_name end title_en")
    rows = part.selectExpr("p_brand brand", "p_partkey k", "p_name title_ja")
    return enrich.mirror_titles(rows, mirror, ["brand", "k"]).select("k", "title_ja", "title_en")


@check("ext_29_dates_from_detail", """SELECT o_orderkey AS k, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS start_date,
  CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS end_date
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def ext_29(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.lit(None).cast("date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"))
    details = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.min("l_shipdate").cast("date").alias("d_start"), F.max("l_shipdate").cast("date").alias("d_end"))
    out = enrich.dated_by_detail(rows, details, "k")
    return out.select("k", F.col("start_date").cast("string").alias("start_date"),
                      F.col("end_date").cast("string").alias("end_date"))


@check("ext_30_enrich", f"""WITH {LISTING_SQL}
SELECT k, CASE WHEN k % 8 = 0 THEN 'page ' || k ELSE title_ja END AS title_ja,
  CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN '17:05' ELSE open_time END AS open_time,
  CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN '18:05' ELSE start_time END AS start_time,
  CASE WHEN price_min IS NULL AND k % 2 = 0 THEN 2000 + k % 1000 ELSE price_min END AS price_min,
  CASE WHEN price_min IS NULL AND k % 2 = 0 THEN false ELSE is_free END AS is_free,
  is_sold_out OR k % 14 = 0 AS is_sold_out FROM listing""")
def ext_30(spark, sf):
    rows = listing(spark, sf)
    page = rows.filter("k % 2 = 0").select("source_url", "k", F.expr(
        "concat('OPEN 17:05 / START: 18:05 前売 ¥', 2000 + k % 1000, ' ドリンク代¥600 GOODS T ¥100 ', "
        "case when k % 14 = 0 then '完売' else '' end)").alias("text"),
        F.expr("case when k % 8 = 0 then concat('page ', k) end").alias("d_title_ja"))
    facts = enrich.detail_facts(page, "source_url").join(
        page.selectExpr("source_url d_url", "d_title_ja"), "d_url")
    return enrich.enrich(rows, facts, overwrite=["title_ja"]).select(
        "k", "title_ja", "open_time", "start_time", "price_min", "is_free", "is_sold_out")


@check("ext_31_matching_leg", """WITH s AS (
  SELECT l_orderkey AS k, l_linenumber * 1000000 + l_partkey AS pos, CAST(l_shipdate AS DATE) AS day FROM lineitem),
 e AS (SELECT k, max(day) AS want FROM s GROUP BY k)
SELECT s.k, min(pos) AS pos FROM s JOIN e USING (k) WHERE day = want GROUP BY s.k""")
def ext_31(spark, sf):
    sections = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey k", "l_linenumber * 1000000 + l_partkey pos", "cast(l_shipdate as date) day") \
        .withColumn("block", F.expr("concat(date_format(day, 'yyyy/MM/dd'), ' Hall ', pos)"))
    events = sections.groupBy("k").agg(F.max("day").alias("start_date")) \
        .withColumn("id", F.col("k")).withColumn("venue_name", F.lit(None).cast("string"))
    return pages.matching_leg(events, sections.select("k", "pos", "block"), "k").select("k", "pos")


@check("ext_32_tour_legs", f"""WITH {NOTICE_SQL}
SELECT k, leg, CAST(d + 2 * (leg - 1) AS VARCHAR) AS start_date,
  CASE leg WHEN 1 THEN '東京都' ELSE '大阪府' END AS pref, 'Hall ' || (c % 9 + leg) AS venue_name,
  opening AS open_time, start AS start_time, p + leg AS price_min, leg = 2 AND c % 2 = 0 AS is_sold_out,
  CASE leg WHEN 1 THEN 'A,B' || c ELSE '' END AS guests FROM n, (SELECT unnest([1, 2]) AS leg)""")
def ext_32(spark, sf):
    leg = ("concat(date_format(date_add(d, {off}), 'yyyy/M/d'), '(土)【', '{pref}', '】会場：Hall ', c % 9 + {leg}, "
           "' 時間：OPEN/START ', opening, ' / ', start, ' 料金：前売 ¥', p + {leg}, '(ドリンク代別途¥600) {guest} 備考：{note} ')")
    one = leg.format(off=0, pref="東京都", leg=1, guest="ゲスト：A/B', c, '", note="なし")
    two = leg.format(off=2, pref="大阪府", leg=2, guest="", note="', case when c % 2 = 0 then 'SOLD OUT' else 'あり' end, '")
    page = noted(spark, sf, f"concat('TOUR ', {one}, {two})").select("k", "text")
    return pages.tour_legs(page, "k", "text").select(
        "k", "leg", F.col("start_date").cast("string").alias("start_date"), "pref", "venue_name", "open_time",
        "start_time", "price_min", "is_sold_out", F.array_join("guests", ",").alias("guests"))


@check("ext_33_classify_text", f"""WITH {NOTICE_SQL}
SELECT k, CASE WHEN c % 7 = 0 THEN 'art' WHEN c % 3 = 0 THEN 'other' ELSE 'music' END AS category,
  c % 3 = 0 AS non_music FROM n""")
def ext_33(spark, sf):
    rows = noted(spark, sf, "concat('Vリーグ 第', k, '節')", "concat('夢の舞台 ', k, ' LIVE')",
                 "concat('WORK-1st Anniversary ', k)").withColumn("tag", F.expr("case when c % 7 = 0 then '展覧会' end"))
    return rows.select("k", flags.classify_text(F.col("text"), F.col("tag"), {"展覧会": "art"}).alias("category"),
                       flags.is_non_music(F.col("text")).alias("non_music"))


@check("ext_4_label_values", f"""WITH {NOTICE_SQL}
SELECT k, opening AS opens, start AS starts, '¥' || p AS price FROM n""")
def ext_4(spark, sf):
    rows = noted(spark, sf, "concat('【OPEN】 ', opening, ' START：', start, ' 料金: ¥', p, ' OPEN 23:59')")
    fields = pages.label_values(F.col("text"), ["OPEN", "START", "料金"])
    return rows.withColumn("f", fields).selectExpr("k", "f['OPEN'] opens", "f['START'] starts", "f['料金'] price")


@check("ext_4_structured_labels", f"""WITH {NOTICE_SQL}
SELECT k, kind, label, value FROM (
  SELECT k, 'column' AS kind, unnest(['開場', '料金', '料金', '開場', '料金', '料金']) AS label,
    unnest([opening, p || '円', (p + 1) || '円', opening, (p + 2) || '円', '無料']) AS value FROM n WHERE c % 3 = 0
  UNION ALL SELECT k, 'list', unnest(['開演', '料金', '料金']), unnest([start, '¥' || p, '¥' || (p + 1)]) FROM n WHERE c % 3 = 1
  UNION ALL SELECT k, 'row', unnest(['開場', '開演', '開演']), unnest([opening, start, '予定']) FROM n WHERE c % 3 = 2)""")
def ext_4b(spark, sf):
    """Column headers with spans, definition lists, row headers."""
    rows = noted(
        spark, sf,
        "concat('<table><thead><tr><th>開場</th><th colspan=\"2\">料金</th></tr></thead><tbody><tr><td rowspan=\"0\">', opening, "
        "'</td><td>', p, '円</td><td>', p + 1, '円</td></tr><tr><td>', p + 2, '円</td><td><b>無料</b></td></tr></tbody></table>')",
        "concat('<dl><dt>開演</dt><dd>', start, '</dd><dt>料金</dt><dd>¥', p, '</dd><dd>¥', p + 1, '</dd></dl>')",
        "concat('<table><tr><th>開場</th><td colspan=\"2\">', opening, '</td></tr><tr><th>開演</th><td>', start, '</td><td>予定</td></tr></table>')")
    found = pages.structured_labels(cut_lineage(pages.elements(rows.select(F.col("k").alias("page_id"), F.col("text").alias("html")))))
    return found.select(F.col("page_id").alias("k"), "kind", "label", "value")


_VISIBLE = r"""trim(regexp_replace({entities}, '[\s\x{{00a0}}\x{{3000}}]+', ' ', 'g'))"""
_STRIPPED = (r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|"
             r"<style\b[^>]*>.*?</style\s*>|<!doctype[^>]*>', ' ', 'g'), '(?s)<[A-Za-z/!?][^>]*>', ' ', 'g')")


def _entities(expr: str) -> str:
    for name, char in pages.ENTITIES.items():
        expr = f"replace({expr}, '{name.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    return expr


@check("ext_1_visible_text", f"""SELECT page_id, {_VISIBLE.format(entities=_entities(_STRIPPED))} AS text,
  {_VISIBLE.format(entities=_entities(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title,
  len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>')) AS headings FROM pages""")
def ext_1(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", pages.visible_text(F.col("html")).alias("text"),
        pages.page_title(F.col("html")).alias("title"),
        F.size(pages.headings(F.col("html"))).alias("headings"))


@check("ext_2_links", r"""WITH a AS (
  SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
    '(?is)<a\b([^>]*)>.*?</a\s*>', 1)) AS attrs,
    generate_subscripts(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
    '(?is)<a\b([^>]*)>.*?</a\s*>', 1), 1) - 1 AS pos FROM pages), h AS (
  SELECT page_id, pos, url, replace(regexp_extract(attrs, '(?i)\bhref\s*=\s*["'']?([^"''>\s]+)', 1), '&amp;', '&') AS href FROM a)
SELECT page_id, min(pos) AS pos, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href
  ELSE href END AS link_url FROM h WHERE href <> '' GROUP BY page_id, link_url""")
def ext_2(spark, sf):
    found = pages.links(table(spark, sf, "pages"))
    return pages.distinct_links(found).select("page_id", "pos", "link_url")


_HIT = "regexp_matches({t}, '(?i)on') AND length({t}) > 5"
_SHOWN = _VISIBLE


@check("ext_3_enclosing_blocks", rf"""WITH n AS (
  SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a [^>]*>(.*?)</a>', 1) AS names,
    {_SHOWN.format(entities=_entities(_STRIPPED.replace("html", "regexp_replace(html, '(?s)^.*?<body>', '')", 1)))} AS body FROM pages), a AS (
  SELECT page_id, body, unnest(names) AS raw, generate_subscripts(names, 1) AS n, array_to_string(names, ' ') AS list FROM n), t AS (
  SELECT page_id, n, body, {_SHOWN.format(entities=_entities("raw"))} AS own, {_SHOWN.format(entities=_entities("list"))} AS ul FROM a)
SELECT page_id, n, CASE WHEN {_HIT.format(t="own")} THEN 'a' WHEN {_HIT.format(t="ul")} THEN 'ul' ELSE 'body' END AS tag,
  CASE WHEN {_HIT.format(t="own")} THEN own WHEN {_HIT.format(t="ul")} THEN ul END AS block
FROM t WHERE ({_HIT.format(t="own")}) OR ({_HIT.format(t="ul")}) OR ({_HIT.format(t="body")})""")
def ext_3b(spark, sf):
    """The smallest element round each link of a page that tells enough."""
    parsed = cut_lineage(pages.elements(texts(spark, sf, "pages")))
    links = parsed.filter("tag = 'a'").select("page_id", "pos")
    found = pages.enclosing_blocks(parsed, links, "(?i)on", longer_than=5, hops=5)
    order = Window.partitionBy("page_id").orderBy("pos")  # the links of one page
    numbered = links.withColumn("n", F.row_number().over(order).cast("long"))
    tags = parsed.select("page_id", F.col("pos").alias("node"), "tag")
    return found.join(numbered, ["page_id", "pos"]).join(tags, ["page_id", "node"]).select(
        "page_id", "n", "tag", F.when(F.col("tag") != "body", F.col("text")).alias("block"))


@check("ext_3_blocks", r"""WITH b AS (
  SELECT page_id, string_split(regexp_replace(html, '(<h1|<p>)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM pages), u AS (
  SELECT page_id, unnest(parts) AS block, generate_subscripts(parts, 1) - 1 AS pos FROM b)
SELECT page_id, pos, length(block) AS n_chars,
  max(CASE WHEN block LIKE '<h1%' THEN pos END) OVER (PARTITION BY page_id ORDER BY pos) AS card FROM u""")
def ext_3(spark, sf):
    cut = pages.blocks(table(spark, sf, "pages"), "page_id", "html", "<h1|<p>")
    marked = pages.carry_marker(cut, "page_id", F.when(F.col("block").startswith("<h1"), F.col("pos")), "card")
    return marked.select("page_id", "pos", F.length("block").alias("n_chars"), "card")

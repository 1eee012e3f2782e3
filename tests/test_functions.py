from datetime import date

import pytest
from pyspark.sql import functions as F

from playbill.functions import dates, flags, names, prices, text, times, urls
from tests.helpers import value, values


def test_norms_fold_width_case_and_notes(spark):
    assert values(spark, text.venue_norm, ["ＳＧＣ ホール（旧 X）　有明", "I’m a Show", "Straße (TOKYO)"]) == \
        ["sgcホール有明", "i'mashow", "strasse"]
    assert values(spark, text.name_key, ["  Ｆoo　 BAR ", None]) == ["foo bar", ""]
    key = lambda c: text.match_key(c, {"ann wilson": "アン"})
    assert values(spark, key, ["ANN  Wilson", "『夢』の〜 Live・(よみ)"]) == ["アン", "夢の~live"]


def test_mostly_ascii(spark):
    assert values(spark, text.mostly_ascii, ["ABC TOUR", "夢のライブ", "", "東京 abcdefg", "東京東京 abc"]) == \
        [True, False, True, True, False]


@pytest.mark.parametrize("line, want", [
    ("OPEN 18:00 / START 19:00", ("18:00", "19:00")),
    ("[OPEN] 17:30 [START] 18:30", ("17:30", "18:30")),
    ("OPEN/START 18:30", ("18:30", "18:30")),
    ("終演 21:00", (None, None)),
])
def test_open_start(spark, line, want):
    assert tuple(value(spark, F.struct(*times.open_start(F.col("t"))), t=line)) == want


@pytest.mark.parametrize("line, want", [
    ("open5:00pm start6:30pm", ("17:00", "18:30")),
    ("open 12:15am start 12:00pm", ("00:15", "12:00")),
    ("開場17時半 開演18時", ("17:30", "18:00")),
    ("TIPOFF 19:05", (None, "19:05")),
])
def test_time_variants(spark, line, want):
    assert tuple(value(spark, F.struct(*times.time_variants(F.col("t"))), t=line)) == want


@pytest.mark.parametrize("line, want", [
    ("開場 17:00／開演 18:30", ("17:00", "18:30")),
    ("16:00開場 17:00開演", ("16:00", "17:00")),
    ("開演 18:30", (None, "18:30")),
    ("開場 未定", (None, None)),
])
def test_labelled_times(spark, line, want):
    assert tuple(value(spark, F.struct(*times.labelled_times(F.col("t"))), t=line)) == want


def test_minutes_before_wraps(spark):
    assert value(spark, times.minutes_before(F.lit("00:10"), 30)) == "23:40"


@pytest.mark.parametrize("line, want", [
    ("前売 ¥3,500 / 当日 ￥4,000", 3500),
    ("前売 3,500円", 3500),
    ("一般 3500円 学割500円引", 3500),
    ("ロッカー 100円 前売 3000円", 3000),
    ("¥3,500円", 3500),
    ("¥0", 0),
    ("無料", None),
])
def test_price_floor(spark, line, want):
    got = value(spark, prices.price_floor(F.col("t")), t=line)
    assert (got and got["price_min"]) == want if want is None or got else False
    assert want is None or got["is_free"] == (want == 0)


@pytest.mark.parametrize("line", ["ADV ¥3,000 (ドリンク代別途¥600)", "ADV ¥3,000 +1DRINK ¥600", "¥3,000 D代600円"])
def test_drink_charge_never_the_floor(spark, line):
    assert value(spark, prices.price_floor(prices.without_drink_charges(F.col("t"))), t=line)["price_min"] == 3000


def test_price_zone_stops_at_merchandise(spark):
    zone = value(spark, prices.price_zone(F.col("t")), t="前売 ¥3000 GOODS ¥100")
    assert "¥100" not in zone and "¥3000" in zone


@pytest.mark.parametrize("line, want", [
    ("入館料 一般 1,500(1,200)円 大学生 1,000円 中学生以下 無料", (1500, None)),
    ("観覧料 前売 2,200円（一般） 当日 2,400円（一般）", (2400, None)),
    ("入館料 1,000円", (1000, None)),
    ("料金 1,000円", (None, None)),
    ("入場無料", (None, True)),
    ("観覧料：無料", (None, True)),
    ("中学生以下 無料", (None, None)),
    ("入館料 一般 99,999円", (None, None)),
    ("入館料　一般　１，２００円", (1200, None)),
])
def test_admission(spark, line, want):
    row = prices.with_admission(spark.createDataFrame([(line,)], "t string"), "t").first()["admission"]
    assert ((row["price_min"], row["is_free"]) if row else (None, None)) == want


@pytest.mark.parametrize("name, block, want", [
    ("leading", "S ¥9,000 (+¥500)\nA ¥7,000", 7000),
    ("tax_included", "前売 ¥3,300（税込）本体 ¥3,000", 3300),
    ("tax_included", "前売 ¥3,300", 3300),
    ("keyword_lines", "Tシャツ ¥500\nADV ¥2,500\n※ADV ¥100", 2500),
    ("backslash_yen", "入場 \\2,000", 2000),
    ("headline", "¥5,000 / ¥3,000", 5000),
    ("zone", "料金 無料 主催 ¥500", 0),
])
def test_price_policies(spark, name, block, want):
    got = value(spark, prices.price_by_policy(F.col("t"), prices.POLICIES[name]), t=block)
    assert got["price_min"] == want


def test_sold_out_vocabulary(spark):
    lines = ["SOLD OUT", "sold-out", "ソールドアウト", "完売御礼", "予定枚数終了しました", "満員御礼",
             "×：予定枚数終了", "予定枚数終了次第", "受付終了", "残りわずか"]
    assert values(spark, flags.is_sold_out, lines) == [True] * 6 + [False] * 4
    assert values(spark, flags.sold_out_by_seats, ["××", "◎×", "△"]) == [True, False, False]


def test_non_music_traps(spark):
    lines = ["Disney on Ice", "B.LEAGUE 2026", "舞台「X」", "RIZIN.50", "K-1 WORLD",
             "WORK-1st Anniversary LIVE", "夢の舞台 TOUR", "プロレス大好き", "BABYRIZIN"]
    assert values(spark, flags.is_non_music, lines) == [True] * 5 + [False] * 4


def test_status_tags_and_title(spark):
    assert values(spark, flags.status_tags, ["公演中止・延期", "延期 配信", "LIVE"]) == \
        [["cancelled"], ["postponed", "streaming"], []]
    assert values(spark, flags.without_status_mark, ["【公演中止】Live", "【中止】"]) == ["Live", "【中止】"]


AS_OF = date(2026, 7, 1)


@pytest.mark.parametrize("line, want", [
    ("2026.7.3(金)", date(2026, 7, 3)),
    ("2026年12月31日", date(2026, 12, 31)),
    ("7.3(金)", date(2026, 7, 3)),
    ("1/15 fri", date(2027, 1, 15)),
    ("5/10 (sun)", date(2026, 5, 10)),
    ("2026.2.30 7.3(金)", None),
    ("no date", None),
])
def test_text_date(spark, line, want):
    assert value(spark, dates.text_date(F.col("t"), F.lit(AS_OF)), t=line) == want


def test_nearest_and_header_year(spark):
    near = lambda m, d, a: value(spark, dates.nearest_year(F.lit(m), F.lit(d), F.lit(a)))
    assert near(12, 31, date(2026, 1, 1)) == date(2025, 12, 31)
    assert near(1, 2, date(2025, 12, 15)) == date(2026, 1, 2)
    assert near(2, 29, date(2027, 2, 1)) == date(2028, 2, 29)
    head = lambda m, y, h: value(spark, dates.header_year(F.lit(m), F.lit(5), F.lit(y), F.lit(h)))
    assert head(1, 2026, 12) == date(2027, 1, 5) and head(12, 2026, 1) == date(2025, 12, 5)
    assert value(spark, dates.rollover_years(F.array(*map(F.lit, [11, 12, 1, 1, 12, 1])), F.lit(2025))) == \
        [2025, 2025, 2026, 2026, 2026, 2027]


@pytest.mark.parametrize("line, want", [
    ("2026年7月3日（金）〜9月10日（日）", (date(2026, 7, 3), date(2026, 9, 10))),
    ("2026.12.1 - 2.15", (date(2026, 12, 1), date(2027, 2, 15))),
    ("2026/7/3 ～ 2026/7/1", None),
    ("7月3日〜9月10日", None),
    ("2020年1月1日〜2026年1月1日", None),
])
def test_date_range(spark, line, want):
    got = value(spark, dates.any_range(F.col("t")), t=line)
    assert (tuple(got) if got else None) == want


def test_titles_and_lineups(spark):
    both = lambda c: F.struct(*names.split_repeated(c))
    assert [tuple(r) for r in values(spark, both, ["LIVE夜LIVE夜 - guest", "abc"])] == [("LIVE夜", "guest"), ("abc", None)]
    assert values(spark, names.split_lineup, ["A / ゲスト：B／TBA／A\nhttps://x.jp/y\n・C・"]) == [["A", "B", "C"]]
    assert values(spark, names.clean_artist, ["O.A. Foo", "guest: Bar", "他", "X", "and more...", " ・Baz／ "]) == \
        ["Foo", "Bar", None, None, None, "Baz"]
    assert values(spark, flags.title_as_lineup, ["Foo", "Foo JAPAN TOUR", "A × B", ""]) == [["Foo"], [], [], []]


def test_generic_links(spark):
    generic = ["http://eplus.jp/", "https://eplus.jp/sf/", "https://w.pia.jp/t/", "https://support.eplus.jp/a",
               "https://t.pia.jp/info/privacy.jsp", "http://eplus.jp/sys/main.jsp"]
    real = ["https://eplus.jp/9mm", "https://w.pia.jp/t/?id=1", "https://t.pia.jp/pia/event.do?x=1", "https://eplus.jp/sys/T1"]
    assert values(spark, urls.is_generic_link, generic + real) == [True] * 6 + [False] * 4
    assert values(spark, urls.provider_slug, ["https://www.japanarts.co.jp/x", "https://eplus.jp/x", "https://info.jp"]) == \
        ["japanarts", "eplus", "jp"]


def test_absolute_url(spark):
    seen = lambda c: urls.absolute_url(c, F.lit("https://h.example/a/b.html?q=1#f"))
    assert values(spark, seen, ["/x", "y", "./z", "//o.example/p", "?n=2", "https://q.example/"]) == [
        "https://h.example/x", "https://h.example/a/y", "https://h.example/a/z", "https://o.example/p",
        "https://h.example/a/b.html?n=2", "https://q.example/"]

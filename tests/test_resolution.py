from datetime import date, datetime


import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playbill.operators import artists, overlap, venues
from playbill.operators.containment import contained_pairs
from playbill.operators.ranking import carry_forward, ordinal_per_key, top_per_key
from playbill.plans.publish import publish
from playbill.sources.dims import HOSTS, registry_from_rows
from tests.helpers import events, numbered

VENUES = [(0, "liquidroom", "LIQUIDROOM", "livehouse", 900), (1, "www", "WWW", "livehouse", 450),
          (2, "www_x", "WWW X", "livehouse", 600), (3, "messe", "幕張メッセ", "arena", 9000),
          (4, "intl_forum", "東京国際フォーラム", "hall", 5012), (5, "budokan", "日本武道館", "arena", 14471)]
ALIASES = [(0, "恵比寿 LIQUIDROOM", "liquidroom"), (1, "Nippon Budokan", "budokan")]
DAY = "2099-05-01"


def test_venue_resolution(spark):
    index = venues.venue_index(*registry_from_rows(spark, VENUES, ALIASES))
    want = {"ＬＩＱＵＩＤＲＯＯＭ": "liquidroom", "恵比寿LIQUIDROOM (旧館)": "liquidroom", "幕張メッセ国際展示場9ホール": "messe",
            "東京国際フォーラム ホールA": "intl_forum", "NIPPON  BUDOKAN": "budokan", "WWW X": "www_x", "WWWX": "www_x",
            "www β": None, "札幌ドーム": None, "": None, None: None}
    rows = spark.createDataFrame([(n,) for n in want], "raw string")
    assert {r["raw"]: r["venue_key"] for r in venues.resolve_venues(rows, "raw", index).collect()} == want


def test_registry_is_checked(spark):
    with pytest.raises(ValueError, match="duplicate venue key"):
        registry_from_rows(spark, VENUES + [(9, "www", "x", "hall", None)])
    with pytest.raises(ValueError, match="unknown venue"):
        registry_from_rows(spark, VENUES, [(0, "x", "nowhere")])


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abc", max_size=7), min_size=1, max_size=12), st.lists(st.text("abc", max_size=12), min_size=1, max_size=12))
def test_containment_equals_brute_force(spark, needles, hays):
    a = spark.createDataFrame([(n,) for n in needles], "needle string").withColumn("g", F.lit(None).cast("int"))
    b = spark.createDataFrame([(h,) for h in hays], "hay string").withColumn("g", F.lit(None).cast("int"))
    got = {(r["needle"], r["hay"]) for r in contained_pairs(a, b, ["g"]).collect()}
    assert got == {(n, h) for n in needles for h in hays if len(n) >= 3 and n in h}


def row(n, source, title=None, lineup=(), venue_key="www", **more):
    return dict(id=str(n), source=source, source_url=f"/{n}", title_ja=title, lineup=list(lineup),
                start_date=more.pop("day", DAY), venue_key=venue_key, **more)


PROMO = ("p1", "p2")


def merged(spark, *rows, hosts=(), festival="fest"):
    out, fates = overlap.merge_promoters(numbered(spark, *rows), PROMO, festival,
                                         spark.createDataFrame(list(hosts), HOSTS), curated=(festival,))
    return {r["id"]: r for r in out.collect()}, {r["id"]: (r["fate"], r["target_id"]) for r in fates.collect()}


def test_fold_into_venue_row(spark):
    out, fates = merged(
        spark, row(0, "www", "超特急 LIVE", start_time=None), row(1, "www", "別の公演"),
        row(2, "p1", "超特急 LIVE 追加公演", is_sold_out=True, start_time="19:00", ticket_links=[("eplus", "u1", None)]),
        row(3, "p2", "超特急 LIVE", start_time="20:00", ticket_links=[("eplus", "u1", None), ("pia", "u2", None)]),
        row(4, "p1", "無関係", day="2099-05-02"), row(5, "p2", "場所不明", venue_key=None))
    assert fates["2"] == ("venue", "0") and fates["3"] == ("venue", "0")
    assert fates["4"][0] == "kept" and fates["5"][0] == "unresolved" and set(out) == {"0", "1", "4"}
    got = out["0"]
    assert got["is_sold_out"] and got["start_time"] == "19:00" and [t["url"] for t in got["ticket_links"]] == ["u1", "u2"]


def test_short_latin_title_is_no_needle(spark):
    _, fates = merged(spark, row(0, "www", "ABC"), row(1, "p1", "ABCDEF tour"))
    assert fates["1"][0] == "kept"
    _, fates = merged(spark, row(0, "www", "x", lineup=["ABC"]), row(1, "p1", "ABCDEF tour"))
    assert fates["1"] == ("venue", "0")


def test_promoter_fold_rules(spark):
    _, fates = merged(
        spark, row(0, "p1", "Magic <LIVE>", ["Miku"], start_time="12:00"), row(1, "p1", "Magic <EXPO>", ["Miku"], start_time="12:00"),
        row(2, "p2", "Miku show", start_time="12:00"), row(3, "p1", "Magic <LIVE>", ["Miku"], start_time="18:00"),
        row(4, "p1", "Magic <LIVE>", ["Miku"]))
    assert fates == {"0": ("kept", None), "1": ("kept", None), "2": ("promoter", "0"), "3": ("kept", None), "4": ("promoter", "0")}


def brute_promoter_fold(rows):
    """First-fit over rows in order, straight from the rule."""
    norm = lambda s: (s or "").lower().replace(" ", "")
    kept, fate = [], {}
    for r in rows:
        def meets(k):
            if k["t"] and r["start_time"] and k["t"] != r["start_time"]:
                return False
            a, b = norm(r["title_ja"]), norm(k["row"]["title_ja"])
            if k["row"]["source"] == r["source"]:
                short, long = sorted((a, b), key=len)
                return len(short) >= 4 and short in long
            mine, theirs = [a] + [norm(n) for n in r["lineup"]], [b] + [norm(n) for n in k["row"]["lineup"]]
            return (any(len(n) >= 3 and n in h for n in mine for h in theirs)
                    or any(len(n) >= 3 and n in h for n in theirs[1:] for h in mine)
                    or any(len(b) >= 4 and b in h for h in mine))
        home = next((k for k in kept if meets(k)), None)
        if home is None:
            kept.append({"row": r, "t": r["start_time"]})
        else:
            home["t"] = home["t"] or r["start_time"]
            fate[r["id"]] = home["row"]["id"]
    return fate


def test_promoter_fold_equals_brute_force(spark):
    import random
    rng = random.Random(7)
    words = ["ring", "ring bolt", "bolt", "gear", "abc", "ab", "rod gear", "ring bolt gear"]
    rows = [row(n, rng.choice(PROMO), rng.choice(words), rng.sample(words, rng.randint(0, 2)),
                start_time=rng.choice([None, "12:00", "18:00"])) for n in range(60)]
    folds = overlap.fold_promoters(numbered(spark, *rows))
    assert {r["id"]: r["target_id"] for r in folds.collect()} == brute_promoter_fold(rows)


def test_festival_rows_fold(spark):
    fest = row(0, "fest", "Summer", venue_key="ss", venue_name="SUMMER SONIC (TOKYO)", end_date="2099-05-02")
    _, fates = merged(spark, fest, row(1, "messe", "SUMMER SONIC 2099", venue_key="messe", day="2099-05-02"),
                      row(2, "club", "summer sonic after party", venue_key="club"), row(3, "p1", "SUMMER SONIC", venue_key="messe"),
                      row(4, "messe", "SUMMER SONIC", venue_key="messe", day="2099-05-03"), hosts=[("ss", "messe")])
    assert {k: v[0] for k, v in fates.items()} == {"0": "kept", "1": "festival", "2": "kept", "3": "festival", "4": "kept"}


def test_duplicate_group_classes(spark):
    rows = numbered(
        spark, row(0, "p1", "Long Show", start_time="12:00", venue_key="a"), row(1, "p1", "Long Show 2", start_time="18:00", venue_key="a"),
        row(2, "p1", "Alpha", venue_key="b"), row(3, "p1", "Omega", venue_key="b"),
        row(4, "p1", "Alpha", venue_key="c"), row(5, "www", "Omega", venue_key="c"),
        row(6, "p1", "Alpha", venue_key="d"), row(7, "p1", "Alpha", venue_key="d"), row(8, "www", "One", venue_key="e"))
    got = {r["venue_key"]: r["class"] for r in overlap.duplicate_groups(rows, PROMO).collect()}
    assert got == {"a": "performances", "b": "distinct", "c": "cross-source", "d": "unexplained"}


def artist_rows(spark):
    return numbered(
        spark, row(0, "www", "夜の会", ["ヨルシカ", "TRUE", "and more"]), row(1, "www", "ヨルシカな夜 DREAMS COME TRUE", []),
        row(2, "www", "x", ["DREAMS COME TRUE", "レモン"]), row(3, "www", "レモンジャム", []), row(4, "www", "Yorushika LIVE", []),
        row(5, "www", "A very long billing title here", ["A very long billing title here", "Yorushika"]),
        row(6, "mus", "ヨルシカ展", [], category="art"), row(7, "www", "UNTRUE stories", []))


def test_artist_index(spark):
    rows = artist_rows(spark)
    index = artists.build_artist_index(rows, artists.alias_table(spark))
    got = {r["id"]: r["artists"] for r in artists.attach_artists(rows, index).collect()}
    assert got == {"0": ["TRUE", "ヨルシカ"], "1": ["DREAMS COME TRUE", "ヨルシカ"], "2": ["DREAMS COME TRUE", "レモン"], "3": [],
                   "4": ["ヨルシカ"], "5": ["ヨルシカ"], "6": [], "7": []}
    assert {(r["norm_key"], r["artist_key"]) for r in index["artist_aliases"].collect()} >= {("yorushika", "ヨルシカ")}


def test_ranking_helpers_equal_plain_windows(spark):
    from pyspark.sql import Window
    rows = spark.range(500).selectExpr("id", "case when id % 3 = 0 then 0 else id % 7 end k", "case when id % 11 = 0 then id end m")
    w = Window.partitionBy("k").orderBy("id")
    plain = rows.withColumn("n", F.row_number().over(w).cast("long")).withColumn(
        "c", F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = {r["id"]: (r["n"], r["c"]) for r in plain.collect()}
    mine = carry_forward(ordinal_per_key(rows, ["k"], [F.col("id")], "n"), ["k"], [F.col("id")], "m", "c")
    assert {r["id"]: (r["n"], r["c"]) for r in mine.collect()} == want
    top = top_per_key(rows, ["k"], [F.col("id")], 5, "n")
    assert {r["id"] for r in top.collect()} == {i for i, (n, _) in want.items() if n <= 5}


def test_publish(spark, tmp_path):
    import json
    from playbill.operators.merge import empty_stage, merge_observations
    from playbill.session import cut_lineage
    from playbill.sinks import calendar, feed
    now, day = F.lit(datetime(2099, 4, 1)), F.lit(date(2099, 4, 1))
    rows = events(
        spark, dict(source="www", source_url="https://w/1", title_ja="ヨルシカ LIVE", start_date=DAY, venue_name="WWW", lineup=["ヨルシカ"]),
        dict(source="creativeman", source_url="https://c/1", title_ja="ヨルシカ", start_date=DAY, venue_name="Shibuya WWW", price_min=5000),
        dict(source="creativeman", source_url="https://c/2", title_ja="K-POP NIGHT", start_date=DAY, venue_name="日本武道館 (東京)"),
        dict(source="www", source_url="https://w/0", title_ja="Old", start_date="2020-01-01"),
        dict(source="www", source_url="https://w/9", title_ja="Junk", start_date=DAY, category="other"))
    staged = cut_lineage(merge_observations(empty_stage(spark), rows, now, "auto").drop("outcome"))
    reg, ali = registry_from_rows(spark, VENUES, ALIASES + [(2, "Shibuya WWW", "www")])
    runs = spark.createDataFrame([(1, "www", 9, None), (2, "www", 3, None), (3, "gone", 0, "x")],
                                 "run_id bigint, source string, found bigint, error string")
    none = lambda kind: spark.createDataFrame([], kind)
    out = publish(staged, reg, ali, artists.alias_table(spark), none(HOSTS), none("event_id string, genres array<string>"),
                  none("event_id string, title_en string"), runs, runs.filter("source = 'www'").select("source").distinct(), day, now)
    feed.write_feed(out.feed, str(tmp_path / "feed"))
    parts = sorted((tmp_path / "feed").glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert doc["sources"] == [{"source": "www", "found": 3, "error": None}]
    assert doc["venues"] == {"budokan": {"capacity": 14471}, "www": {"capacity": 450}}
    got = {e["source_url"]: e for e in doc["events"]}
    assert set(got) == {"https://w/1", "https://c/2"}
    assert got["https://w/1"]["price_min"] == 5000 and got["https://w/1"]["artists"] == ["ヨルシカ"]
    assert got["https://c/2"]["genres"] == ["k-pop"] and "id" not in got["https://c/2"]
    calendar.write_calendars(out.calendars, str(tmp_path / "cal"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "cal" / "calendar=events").glob("part-*")))
    assert text.startswith("BEGIN:VCALENDAR\r\n") and text.endswith("END:VCALENDAR\r\n") and text.count("BEGIN:VEVENT") == 2
    assert (tmp_path / "cal" / "calendar=ical%2Fbudokan").exists()




def test_billing_line_that_begins_like_a_role(spark):
    """A long title copied into the line-up is no act, whatever it begins with; a guest is one."""
    rows = numbered(spark, *[
        dict(source="www", source_url=str(n), title_ja=title, start_date=DAY, venue_name="WWW", venue_key="www", lineup=lineup)
        for n, (title, lineup) in enumerate([
            ("With the long and winding road", ["With the long and winding road", "with Yorushika"]),
            ("With ABBA", ["With ABBA"]), ("A night to remember, again", ["A night to remember, again"])])])
    got = artists.lineup_names(rows, artists.alias_table(spark)).select("id", "cleaned").collect()
    assert sorted(map(tuple, got)) == [("0", "Yorushika"), ("1", "ABBA")]


def test_lineup_names_are_folded_once(spark):
    """Acts get the key of their curated spelling, and each name is folded by
    one Python step; folding it again would hold one more worker per core."""
    rows = numbered(spark, {"id": "a", "source": "s", "source_url": "u", "title_ja": "題", "lineup": ["ＺＵＴＯＭＡＹＯ", "Gen Hoshino", "Ｐerfume"]})
    names = artists.lineup_names(rows, artists.alias_table(spark))
    got = {r["pos"]: (r["cleaned"], r["name"], r["key"]) for r in names.collect()}
    assert got == {0: ("ＺＵＴＯＭＡＹＯ", "ずっと真夜中でいいのに。", "ずっと真夜中でいいのに。"),
                   1: ("Gen Hoshino", "星野源", "星野源"), 2: ("Ｐerfume", "Ｐerfume", "perfume")}
    plan = names._jdf.queryExecution().optimizedPlan().toString().splitlines()
    steps = [line for line in plan if "ArrowEvalPython" in line and "spelling" not in line]  # but for the small table of aliases
    assert len(steps) <= 2, steps  # titles and names

"""Containment index, first-fit rounds, page structure, policies, and the rules
whose undoing nothing else would show."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from playbill.functions import dates, names
from playbill.operators import merge, overlap, pages, policies
from playbill.operators.containment import contained_pairs
from tests.helpers import events, numbered, value
from tests.test_resolution import PROMO, brute_promoter_fold, merged, row


@pytest.mark.parametrize("heavy", [10_000, 3])
def test_containment_with_a_common_title_and_short_needles(spark, heavy):
    """A third of all rows show one title; its pieces are heavy."""
    r = random.Random(heavy)
    words = ["festa", "fe", "f", "夏祭", "夏", "grand festa live", "festa 2", "live"]
    hays = [(r.choice([1, 2, None]), "grand festa live 夏祭" if k % 3 == 0 else f"{r.choice(words)}{r.choice(words)}{k % 40}") for k in range(300)]
    needles = [(r.choice([1, 2, None]), r.choice(words)) for _ in range(80)]
    a, b = spark.createDataFrame(needles, "g int, needle string"), spark.createDataFrame(hays, "g int, hay string")
    for shortest in (1, 3):
        got = [tuple(x) for x in contained_pairs(a, b, ["g"], shortest=shortest, heavy=heavy).select("g", "needle", "hay").collect()]
        want = {(g, n, h) for g, n in needles for g2, h in hays if g == g2 and len(n) >= shortest and n in h}
        assert len(got) == len(set(got)) and set(got) == want
    every = {(x["needle"], x["hay"]) for x in contained_pairs(a, b, [], heavy=heavy).collect()}
    assert every == {(n, h) for _, n in needles for _, h in hays if len(n) >= 3 and n in h}


def test_containment_of_nothing(spark):
    a, b = spark.createDataFrame([], "g int, needle string"), spark.createDataFrame([(1, "abc")], "g int, hay string")
    assert contained_pairs(a, b, ["g"]).count() == 0
    assert contained_pairs(b.withColumnRenamed("hay", "needle"), a.withColumnRenamed("needle", "hay"), ["g"]).count() == 0


def test_first_fit_of_a_hot_group(spark):
    """One day and venue holds most rows, a third of them one title; times come
    late, so kept rows take them from rows folded into them."""
    r = random.Random(11)
    words = ["ring", "ring bolt", "bolt", "gear", "abc", "ab", "rod gear", "ring bolt gear", "x"]
    rows = [row(n, r.choice(PROMO), "ring bolt" if n % 3 == 0 else r.choice(words), r.sample(words, r.randint(0, 3)),
                start_time=r.choice([None, None, "", "12:00", "18:00", "19:00"])) for n in range(150)]
    got = {x["id"]: x["target_id"] for x in overlap.fold_promoters(numbered(spark, *rows)).collect()}
    assert got == brute_promoter_fold(rows)


def test_first_fit_in_order_equals_rounds(spark):
    """Several days and venues, some taken in order and some in rounds."""
    r = random.Random(5)
    words = ["ring", "ring bolt", "bolt", "gear", "abc", "ab", "rod gear", "夏祭", "x"]
    rows = [row(n, r.choice(PROMO), r.choice(words), r.sample(words, r.randint(0, 2)), venue_key=r.choice("aaaabc"),
                start_time=r.choice([None, "", "12:00", "18:00"])) for n in range(120)]
    want = {}
    for key in "abc":
        want |= brute_promoter_fold([x for x in rows if x["venue_key"] == key])
    for in_order in (0, 60, 20_000):
        got = {x["id"]: x["target_id"] for x in overlap.fold_promoters(numbered(spark, *rows), in_order=in_order).collect()}
        assert got == want


def test_first_fit_jobs_do_not_grow_with_a_chain(spark):
    """Each row overlaps only the one before it; rounds settle one a time."""
    rows = [row(n, PROMO[n % 2], f"title {n:03d}", [f"name {n:03d}", f"name {n + 1:03d}"], start_time=None) for n in range(12)]
    events = numbered(spark, *rows).localCheckpoint()
    spark.sparkContext.setJobGroup("chain", "first fit of a chain")
    try:
        got = {x["id"]: x["target_id"] for x in overlap.fold_promoters(events).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == brute_promoter_fold(rows) == {str(n): str(n - 1) for n in range(1, 12, 2)}
    assert jobs < 80


def test_first_overlap_looks_up_distinct_strings(spark, monkeypatch):
    """Many rows with one title: the search sees the title once a side, and
    every row still finds the first venue row."""
    rows = [row(n, "p1", "ring bolt", ["gear"]) for n in range(30)] + [row(n, "www", "ring bolt live", ["rod"]) for n in range(30, 60)]
    seen, search = [], overlap.overlapping_parts
    monkeypatch.setattr(overlap, "overlapping_parts", lambda a, b: seen.extend([a.count(), b.count()]) or search(a, b))
    parts = [overlap.parts_of(numbered(spark, *side)) for side in (rows[:30], rows[30:])]
    got = {x["id"]: x["venue_id"] for x in overlap.first_overlap(*parts).collect()}
    assert got == {str(n): "30" for n in range(30)}
    assert seen == [2, 2]


def test_short_festival_names(spark):
    fest = [row(0, "fest", "x", venue_key="f1", venue_name="Q (TOKYO)"), row(1, "fest", "y", venue_key="f2", venue_name="夏 (TOKYO)"),
            row(2, "fest", "z", venue_key="f3", venue_name="JK")]
    _, fates = merged(spark, *fest, row(3, "messe", "Q day", venue_key="messe"), row(4, "p1", "夏の夜", venue_key="club"),
                      row(5, "p1", "jk rally", venue_key="club"), row(6, "p1", "none", venue_key="club"), hosts=[("f1", "messe")])
    assert {k: v[0] for k, v in fates.items()} == {"0": "kept", "1": "kept", "2": "kept", "3": "festival", "4": "festival", "5": "festival", "6": "kept"}


def test_links_of_folded_rows_keep_their_printed_order(spark):
    link = lambda u: ("eplus", u, None)
    out, _ = merged(spark, row(0, "www", "long title", ticket_links=[link("b")]),
                    row(1, "p1", "long title", start_time="18:00", ticket_links=[link("z"), link("c"), link("b")]),
                    row(2, "p2", "long title", start_time="18:00", ticket_links=[link("a"), link("z"), link("y")]))
    assert [x["url"] for x in out["0"]["ticket_links"]] == ["b", "z", "c", "a", "y"]


def test_spaced_kanji_dates(spark):
    text = "会期　2026年 5月 1日 （金） ～ 7月 12日"
    assert tuple(value(spark, dates.any_range(F.col("t")), t=text)) == (date(2026, 5, 1), date(2026, 7, 12))


def test_a_leg_is_not_named_by_the_beginning_of_a_later_day(spark):
    legs = spark.createDataFrame([(1, 0, "2026/5/12 Hall"), (1, 1, "2026/5/1 Hall"), (2, 0, "2026/05/10"), (2, 1, "2026/5/2")],
                                 "page int, pos int, block string")
    rows = spark.createDataFrame([(1, "a", date(2026, 5, 1), None), (2, "b", date(2026, 5, 1), None)],
                                 "page int, id string, start_date date, venue_name string")
    got = {x["id"]: x["pos"] for x in pages.matching_leg(rows, legs, "page").collect()}
    assert got == {"a": 1, "b": 0}


def test_observations_of_one_moment_collapse_in_any_order(spark):
    same = dict(source="s", source_url="/1", start_date="2099-01-01")
    rows = [dict(same, title_ja=t, start_time=c, price_min=p) for t, c, p in
            (("a", "18:00", None), ("b", None, 5), ("c", "19:00", 7), ("d", None, None))]
    seen = set()
    for k in range(6):
        random.Random(k).shuffle(rows)
        got = merge.collapse_batch(events(spark, *rows).repartition(1 + k % 3), F.lit(datetime(2099, 1, 1))).collect()
        assert len(got) == 1
        seen.add((got[0]["title_ja"], got[0]["start_time"], got[0]["price_min"]))
    assert len(seen) == 1


def test_bills_have_no_cap_but_that_of_their_policy(spark):
    acts = "/".join(f"act {k}" for k in range(100))
    count = lambda p: value(spark, F.size(names.split_lineup(F.col("t"), p)), t=acts)
    assert count(names.LineupPolicy()) == 100 and count(names.HEADLINER) == 100 and count(names.CARD_BODY) == 40
    assert value(spark, names.split_lineup(F.col("t"), names.HEADLINER), t="x" * 200) == ["x" * 200]
    assert value(spark, names.split_lineup(F.col("t"), names.CARD_BODY), t="x" * 41) == []


def test_three_layouts_of_a_bill(spark):
    assert value(spark, names.split_lineup(F.col("t"), names.CARD_BODY), t=(
        "【出演】THE A／B\nOPEN 18:00 / START 19:00\n※予告なく変更\nGUEST：C\n[DJ] D / B\n\n詳細は後日")) == ["THE A", "B", "C", "D"]
    assert value(spark, names.split_lineup(F.col("t"), names.LINES_ONLY), t=(
        "出演者：A、B\n- GUEST -\n・C（x/y）\nhttps://a.example/b\n出演者は後日発表\nA、B")) == ["A、B", "C（x/y）"]
    assert value(spark, names.split_lineup(F.col("t"), names.HEADLINER), t="A【ゲスト】B\nC、D,C\n※注") == ["AB", "C", "D"]


def test_policies_are_chosen_by_a_table(spark):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(["a", "b", "c", None, "a"])], "k int, source string")
    chosen = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z"), (None, "y")], "source string, policy string")
    out = policies.by_policy(rows, chosen, {"x": F.col("k") + 10, "y": F.col("k") + 100, "z": F.lit(-1)}, "v")
    assert {r["k"]: r["v"] for r in out.collect()} == {0: 10, 1: 101, 2: None, 3: 103, 4: 14} and out.columns == ["k", "source", "v"]
    out = policies.by_policy(rows, chosen, {"x": F.lit(1), "y": F.lit(2), "z": F.lit(3)}, "v", default="z")
    assert {r["k"]: r["v"] for r in out.collect()} == {0: 1, 1: 2, 2: 3, 3: 2, 4: 1}
    with pytest.raises(ValueError, match="no policy"):
        policies.by_policy(rows, chosen, {"x": F.lit(1)}, "v")


def parsed(spark, *html):
    return pages.elements(spark.createDataFrame(list(enumerate(html)), "page_id int, html string"))


def test_elements_keep_text_once(spark):
    rows = parsed(spark, "<div>a <b>b<i>c</i></b> d<script>no()</script></div><p>e", "", None).collect()
    runs = {r["page_id"]: r["runs"] for r in rows if r["pos"] == pages.PAGE}
    assert runs == {0: ["a", "b", "c", "d", "e"], 1: [], 2: []}
    assert {(r["tag"], r["text_from"], r["text_to"]) for r in rows if r["pos"] >= 0} == \
        {("div", 0, 4), ("b", 1, 3), ("i", 2, 3), ("script", 4, 4), ("p", 4, 5)}


def test_enclosing_blocks(spark):
    card = "<li><h3>{t}</h3><div><p>OPEN 18:00 / START 19:00, Hall</p></div><p><span><a href='{n}'>more</a></span></p></li>"
    table = parsed(spark, "<ul>" + card.format(t="One", n=1) + card.format(t="Two", n=2) + "</ul><a href='3'>open</a>",
                   "<a href='1'>open from 18:00, all seats reserved</a>", "<div><a href='1'>x</a></div>")
    links = table.filter("tag = 'a'").select("page_id", "pos")
    got = sorted((r["page_id"], r["pos"], r["text"]) for r in pages.enclosing_blocks(table, links, "(?i)open").collect())
    text = "{} OPEN 18:00 / START 19:00, Hall more"
    assert [(p, t) for p, _, t in got] == [(0, text.format("One")), (0, text.format("Two")), (1, "open from 18:00, all seats reserved")]
    assert pages.enclosing_blocks(table, links, "(?i)open", hops=3).filter("page_id = 0").count() == 0


def grid(spark, html):
    squares = pages.table_grid(parsed(spark, html)).collect()
    out = {}
    for r in squares:
        out.setdefault((r["table_pos"], r["row"]), {})[r["col"]] = r["text"]
    return [[cells[c] for c in sorted(cells)] for _, cells in sorted(out.items())]


def test_spans_of_a_table(spark):
    assert grid(spark, "<table><tr><td rowspan=2>a<td colspan=2>b<tr><td>c<td>d</table>") == [["a", "b", "b"], ["a", "c", "d"]]
    # a span reaches over the cells of later rows, ends with the table, and 0 means to its end
    assert grid(spark, "<table><tr><td>a</td><td rowspan=9>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td rowspan=0>e</td></tr></table>") == \
        [["a", "b"], ["c", "b", "d"], ["e", "b"]]
    assert grid(spark, "<table><tr><td colspan=99999>a</td></tr></table>") == [["a"] * pages.MOST_COLUMNS]
    # a table in a cell has a grid of its own
    assert grid(spark, "<table><tr><td><table><tr><td>x</td></tr></table></td><td>y</td></tr></table><table><td>z</td></table>") == [["x", "y"], ["x"], ["z"]]


def test_labels_by_structure(spark):
    html = ("<table><thead><tr><th rowspan=2>日</th><th colspan=2>時間</th></tr><tr><th>開場</th><th>開演</th></tr></thead>"
            "<tbody><tr><td>1</td><td>17:00</td><td>18:00</td></tr><tr><td>2</td><td colspan=2>未定</td></tr></tbody></table>"
            "<table><tr><th>料金</th><td>¥1</td><td>¥2</td></tr><tr><th>会場</th><td>Hall</td></tr></table>"
            "<dl><dt>出演</dt><dd>A</dd><dd>B</dd><div><dt>主催</dt><dd>C</dd></div></dl><dl><dd>no label</dd></dl>")
    found = pages.structured_labels(parsed(spark, html))
    got = sorted((r["kind"], r["label"], r["value"]) for r in found.collect())
    assert got == sorted([
        ("column", "日", "1"), ("column", "開場", "17:00"), ("column", "開演", "18:00"), ("column", "日", "2"), ("column", "開場", "未定"),
        ("column", "開演", "未定"), ("row", "料金", "¥1"), ("row", "料金", "¥2"), ("row", "会場", "Hall"),
        ("list", "出演", "A"), ("list", "出演", "B"), ("list", "主催", "C")])
    labels = pages.first_values(found, ["page_id"]).first()["labels"]
    assert labels["日"] == "1" and labels["料金"] == "¥1" and labels["出演"] == "A"




def test_names_by_token_runs(spark):
    """Equi-joins over runs of letters and digits find what the boundary
    pattern finds, at the same place."""
    import re

    from playbill.operators import artists
    r = random.Random(4)
    words = ["the", "ring", "rings", "a", "7", "of", "fire", "bolt", "x"]
    marks = [" ", " ", "-", "&", "é", " ' ", "・"]
    make = lambda n: "".join(r.choice(words) + r.choice(marks) for _ in range(n)).strip()
    keys = sorted({k for k in (make(r.randint(1, 4)) for _ in range(150)) if re.fullmatch(r"[0-9a-z]([\x20-\x7e]*[0-9a-z])?", k)})
    hays = sorted({make(r.randint(1, 12)) for _ in range(150)} | {"", "é", "the ring of fire"})
    got = {(x["hay"], x["needle"]): x["at"] for x in artists.token_run_spans(
        spark.createDataFrame([(h,) for h in hays], "hay string"), spark.createDataFrame([(k,) for k in keys], "needle string")).collect()}
    want = {(h, k): m.start() + 1 for h in hays for k in keys if (m := re.search(f"(?<![0-9a-z]){re.escape(k)}(?![0-9a-z])", h))}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_plain_one(spark, how):
    """A third of the rows have one key, a third none."""
    from playbill.operators.ranking import heavy_keys, spread_join
    left = spark.range(900).selectExpr("id", "case id % 3 when 0 then 'hot' when 1 then concat('k', id % 50) end k")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("none", 5)], "k string, v int")
    want = sorted(map(tuple, left.join(right, "k", how).select("id", "k", "v").collect()), key=str)
    for most in (10, 0):
        got = spread_join(left, right, "k", how, max_rows=most, salt=4)
        assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=str) == want
    assert "hot" in heavy_keys(left, "k")
    assert heavy_keys(left.limit(0), "k") == []


def test_a_hot_key_spans_ranges(spark):
    from playbill.operators.ranking import in_ranges, ordinal_per_key
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('k', id) end k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges are joined otherwise
    try:
        dealt = in_ranges(rows.repartition(7), ["k"], [F.col("id")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt.filter("k = 'hot'").select("_range").distinct().count() > 1
    got = ordinal_per_key(rows.repartition(5), ["k"], [F.col("id").desc()]).filter("k = 'hot'").collect()
    assert {x["id"]: x["ordinal"] for x in got} == {i: 1000 - i // 3 for i in range(0, 3000, 3)}


def test_versions_are_bucketed_and_compacted_by_level(spark, tmp_path):
    """Many batches, replays in between: the state equals that of one table,
    and a batch's plan reads its own buckets only."""
    from playbill.sources import staged
    from playbill.streaming import ingest
    root, r, want = str(tmp_path / "root"), random.Random(1), {}
    for batch in range(12):
        seen = sorted(r.sample(range(30), 4))
        rows = events(spark, *[dict(source="s", source_url=f"/{k}", title_ja=f"t{batch}", start_date="2099-01-01") for k in seen]) \
            .withColumn("observed_at", F.lit(datetime(2098, 1, 1 + batch)))
        want.update({f"/{k}": f"t{batch}" for k in seen})
        for _ in range(1 + batch % 5 // 4):
            ingest.apply_batch(rows, batch, root)
    state = staged.current(spark, root)
    assert {x["source_url"]: x["title_ja"] for x in state.collect()} == want
    runs = staged.list_runs(spark, root)
    assert max(x[0] for x in runs) == 1 and len(runs) < 12
    touched = staged.touched_buckets(state.limit(1).select("id"))
    plan = staged.current(spark, root, touched=touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    part = {x["source_url"] for x in staged.current(spark, root, touched=touched).collect()}
    assert part and part < set(want)
    assert staged.current(spark, root, before=0).count() == 0
    assert staged.current(spark, str(tmp_path / "nothing")).count() == 0


def test_titles_of_a_run_and_their_answers(spark):
    """Only queued rows are asked for, the cap cuts a run, blank answers and
    answers nobody asked for are not taken, and the next run asks the rest."""
    from playbill.operators import classify
    rows = spark.createDataFrame([(k, "東京公演" if k % 2 else "plain", "real" if k == 3 else None) for k in range(30)],
                                 "id long, title_ja string, title_en string")
    cache = spark.createDataFrame([(5, "five")], "event_id long, title_en string")
    queue = classify.title_queue(classify.apply_title_en(rows, cache), [F.col("id")], cap=7, batch=3)
    assert [(r["id"], r["batch_no"]) for r in queue.orderBy("id").collect()] == [(1, 0), (7, 0), (9, 0), (11, 1), (13, 1), (15, 1), (17, 2)]
    said = spark.createDataFrame([(1, "one"), (1, "a one"), (7, " "), (9, None), (2, "two"), (19, "later")], "event_id long, title_en string")
    fresh = classify.accept_titles(queue, said)
    assert [tuple(r) for r in fresh.select("event_id", "title_en").collect()] == [(1, "a one")]
    again = classify.title_queue(classify.apply_title_en(rows, cache.unionByName(fresh)), [F.col("id")], cap=7, batch=3)
    assert sorted(r["id"] for r in again.collect()) == [7, 9, 11, 13, 15, 17, 19]


def test_pages_of_plain_tags_read_as_the_parser_reads_them(monkeypatch):
    """Plain tags are cut by a pattern, everything else goes through the
    parser; both give the same elements."""
    pieces = ["<p>", "</p>", '<td colspan="2">', "<td>", "<table>", "</table>", "<tr>", "<dl>", "<dt>", '<dd class="a b">', "<br>",
              '<div id="a" id="b">', "</div>", " x ", ">", "<optio", "&amp;", "<!-- c -->", "<script>", "</script>", "<title>", "</title>"]
    rng = random.Random(3)
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(2000)]
    plain = '<table><tr><th>a</th><td colspan="2">b</td></tr></table>'
    got = [pages._Reader.read(p) for p in made]
    with monkeypatch.context() as m:
        m.setattr(pages, "_PLAIN", pages.re.compile("(?!)"))
        assert got == [pages._Reader.read(p) for p in made]
    monkeypatch.setattr(pages._Reader, "feed", None)  # not needed for plain tags
    assert len(pages._Reader.read(plain)) == 5


def test_rules_are_asked_once_for_a_label(spark):
    """A compound rule reads the other rules' answer without asking again,
    and the queue of uncertain rows can be built."""
    from playbill.operators import classify
    labels = classify.rule_labels(F.col("t"), [("x", "rule-of-x")], compound=("y", ("p", "q")))
    rows = spark.createDataFrame([("rule-of-x p q",), ("pq",), ("",)], "t string").select(labels.alias("l"))
    assert [r["l"] for r in rows.collect()] == [["x", "y"], ["y"], []]
    assert rows._jdf.queryExecution().analyzed().toString().count("rule-of-x") == 1
    queue = classify.verdict_queue(spark.createDataFrame([(k,) for k in range(5)], "id long"), [F.col("id")], cap=3, batch=2)
    assert sorted(map(tuple, queue.select("id", "batch_no").collect())) == [(0, 0), (1, 0), (2, 1)]

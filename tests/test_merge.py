from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from playbill.operators import identity, merge, workqueue
from playbill.plans.observe import observe
from playbill.sources import staged as versions
from playbill.streaming import ingest
from tests.helpers import events

T1, T2 = datetime(2026, 7, 1), datetime(2026, 7, 2)
BASE = dict(source="hall", source_url="/e/1", title_ja="Live", start_date="2099-01-01", start_time="19:00",
            price_min=3000, ticket_links=[("eplus", "u", None)])


def stage(spark, *rows, status="pending"):
    first = merge.merge_observations(merge.empty_stage(spark), events(spark, *rows), F.lit(T1))
    return first.drop("outcome").withColumn("status", F.lit(status))


def again(spark, staged, *rows, default="pending"):
    return merge.merge_observations(staged, events(spark, *rows), F.lit(T2), default).collect()


def test_new_unchanged_changed(spark):
    staged = stage(spark, BASE)
    row = staged.first()
    assert row["first_seen"] == row["updated_at"] == T1 and len(row["id"]) == 16
    same, = again(spark, staged, BASE)
    assert same["outcome"] == "unchanged" and same["last_seen"] == T2 and same["updated_at"] == T1
    moved, = again(spark, staged, {**BASE, "start_time": "20:00"})
    assert moved["outcome"] == "changed" and moved["updated_at"] == T2 and moved["first_seen"] == T1
    both = {r["source_url"]: r["outcome"] for r in again(spark, staged, {**BASE, "source_url": "/e/2"})}
    assert both == {"/e/1": None, "/e/2": "new"}


def test_barer_observation_is_unchanged(spark):
    bare = {**BASE, "start_time": None, "price_min": None, "ticket_links": []}
    row, = again(spark, stage(spark, BASE), bare)
    assert row["outcome"] == "unchanged" and row["price_min"] == 3000 and len(row["ticket_links"]) == 1


def test_false_and_zero_are_values(spark):
    row, = again(spark, stage(spark, {**BASE, "is_free": True}), {**BASE, "is_free": False, "price_min": 0})
    assert row["is_free"] is False and row["price_min"] == 0


def test_sold_out_latch(spark):
    row, = again(spark, stage(spark, {**BASE, "is_sold_out": True}), BASE)
    assert row["is_sold_out"] and row["outcome"] == "unchanged"
    row, = again(spark, stage(spark, BASE), {**BASE, "is_sold_out": True})
    assert row["is_sold_out"] and row["outcome"] == "changed"


@pytest.mark.parametrize("stored, default, changed, want", [
    ("approved", "pending", True, "pending"), ("approved", "auto", True, "approved"),
    ("rejected", "pending", True, "rejected"), ("rejected", "auto", True, "rejected"),
    ("pending", "auto", True, "pending"), ("approved", "pending", False, "approved"),
])
def test_status_rules(spark, stored, default, changed, want):
    row = {**BASE, "title_ja": "Other"} if changed else BASE
    got, = again(spark, stage(spark, BASE, status=stored), row, default=default)
    assert got["status"] == want


def test_batch_collapse_keeps_last_filled(spark):
    batch = events(spark, BASE, {**BASE, "title_ja": "Later", "start_time": None, "ticket_links": [], "is_sold_out": True},
                   {**BASE, "title_ja": "Last", "price_min": 2500}).withColumn("at", F.monotonically_increasing_id())
    row, = merge.collapse_batch(batch, F.col("at")).collect()
    assert (row["title_ja"], row["start_time"], row["price_min"], row["is_sold_out"], len(row["ticket_links"])) == \
        ("Last", "19:00", 2500, True, 1)


def test_approve_and_set_status(spark):
    staged = stage(spark, BASE, {**BASE, "source": "club", "source_url": "/e/9"})
    out = merge.approve_pending(staged, F.lit(T2), "hall")
    assert {r["source"]: r["status"] for r in out.collect()} == {"hall": "approved", "club": "pending"}
    assert out.filter("_approved").count() == 1
    ids = staged.filter("source = 'club'").select("id")
    out = merge.set_status(staged, ids, "rejected", F.lit(T2))
    assert {r["source"]: r["status"] for r in out.collect()} == {"hall": "pending", "club": "rejected"}


def test_attempts_count_and_reset(spark):
    kind = "event_id string, attempts int, content_hash string, last_attempt timestamp"
    old = spark.createDataFrame([("a", 1, "h", T1), ("b", 2, "h", T1), ("c", 1, "h", T1)], kind)
    now = spark.createDataFrame([("a", "h"), ("b", "new"), ("d", "h")], "event_id string, content_hash string")
    got = {r[0]: r[1] for r in merge.note_attempts(old, now, F.lit(T2)).collect()}
    assert got == {"a": 2, "b": 1, "c": 1, "d": 1}


def test_fragments_ordinals_spans(spark):
    rows = spark.createDataFrame([("u", date(2026, 1, 1), 1), ("u", date(2026, 1, 2), 1), ("v", date(2026, 1, 1), 1),
                                  ("w", date(2026, 1, 1), 1), ("w", date(2026, 1, 1), 2)], "url string, day date, leg int")
    got = sorted(r["source_url"] for r in identity.fragment_repeats(rows, "url", "day", "leg").collect())
    assert got == ["u#2026-01-01", "u#2026-01-02", "v", "w#2026-01-01-1", "w#2026-01-01-2"]
    placed = identity.ordinal_fragment(rows.withColumn("p", F.monotonically_increasing_id()), ["day"], [F.col("url"), F.col("leg")], "day")
    assert sorted(r["fragment"] for r in placed.collect() if r["day"] == date(2026, 1, 1)) == \
        ["2026-01-01", "2026-01-01-2", "2026-01-01-3", "2026-01-01-4"]


def test_hash_ignores_width_and_space(spark):
    rows = spark.createDataFrame([("Ａ　B",), ("A B",), ("AB",)], "t string")
    assert rows.select(identity.title_hash(F.col("t"))).distinct().count() == 1


def test_run_and_queue(spark):
    rows = [dict(source="s", source_url=f"/e/{n:02}", start_date="2099-01-01") for n in range(45)]
    batch = events(spark, *rows).withColumn("observed_at", F.lit(T1))
    sources = spark.createDataFrame([("s", "pending", False, True), ("quiet", "auto", False, True), ("off", "auto", True, False)],
                                    "source string, default_status string, allow_empty boolean, supports_detail boolean")
    tries = spark.createDataFrame([], "event_id string, attempts int, content_hash string, last_attempt timestamp")
    run = observe(merge.empty_stage(spark), batch, sources, tries, F.lit(date(2026, 7, 1)), F.lit(T1), F.col("observed_at"))
    assert run.queue.count() == 40 and run.queue.filter("tier = 1").count() == 40
    errors = {r["source"]: (r["found"], r["error"]) for r in run.report.collect()}
    assert errors["s"] == (45, None) and errors["off"] == (0, None) and "0 events" in errors["quiet"][1]


def test_backlog_gives_up_after_two_tries(spark):
    staged = stage(spark, dict(source="s", source_url="/a", start_date="2099-01-01"),
                   dict(source="s", source_url="/b", start_date="2099-01-01"),
                   dict(source="s", source_url="/c", start_date="2020-01-01"),
                   dict(source="s", source_url="/d", start_date="2020-01-01", end_date="2099-01-01"))
    tried = staged.select(F.col("id").alias("event_id"), F.lit(2).alias("attempts"),
                          F.when(F.col("source_url") == "/a", F.col("content_hash")).otherwise("old").alias("content_hash"))
    got = workqueue.backlog(staged, tried, F.lit(date(2026, 7, 1))).select("source_url").collect()
    assert {r[0] for r in got} == {"/b", "/d"}


def test_stream_equals_batch_and_replay_is_idempotent(spark, tmp_path):
    root, feed, state = (str(tmp_path / n) for n in ("root", "feed", "state"))
    first = events(spark, BASE).withColumn("observed_at", F.lit(T1))
    second = events(spark, {**BASE, "start_time": None, "title_ja": "New"}).withColumn("observed_at", F.lit(T2))
    for rows in (first, second):
        rows.coalesce(1).write.mode("append").parquet(feed)
        ingest.ingest(ingest.read_observations(spark, feed), root, state).awaitTermination()
    state_now = versions.current(spark, root).collect()
    assert [(r["title_ja"], r["start_time"], r["first_seen"], r["last_seen"]) for r in state_now] == [("New", "19:00", T1, T2)]
    ingest.apply_batch(second, 1, root)
    assert versions.current(spark, root).collect() == state_now
    versions.compact(spark, root, str(tmp_path / "compact"), 2)
    assert versions.current(spark, str(tmp_path / "compact")).collect() == state_now

"""First-fit folding: small groups in order, large ones in rounds.

A row joins the first kept row of its group that agrees with it and overlaps
it, and is kept when there is none.  A group with a counted, bounded number of
shown strings and links is taken in order, as one group of a task.  In larger
ones all rows that can be settled are settled at once, round by round:

* a row looks at the first earlier row that overlaps it and is not passed: one
  that is still open, or kept with a time that agrees;
* without such a row it is kept; behind an open one it waits; a kept one with
  a known time takes it;
* a kept row whose time is unknown takes the first open row that has one, and
  with it the time; rows without a time need not wait.

The first open row of a group always settles, so rounds end.  Who overlaps whom
is never listed: rows meet through the strings they show.  Per string, source
and time only the first row counts, which is an aggregate that combines before
it is shuffled, so a group with a third of all rows is spread over its strings.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.text import needle_floor
from playbill.operators.containment import contained_pairs
from playbill.session import cut_lineage, shared_folder, store

SHORTEST_NAME = 3
#: shown strings and links up to which a group is taken in order
IN_ORDER = 20_000
OPEN, KEPT, FOLDED = "open", "kept", "folded"


def string_links(shown: DataFrame) -> DataFrame:
    """(g, p, q, inside, around, long): strings of one group of which one lies
    in the other; ``long`` says that the inner one may be a title's needle."""
    pairs = contained_pairs(shown.select("g", F.col("part").alias("needle")), shown.select("g", F.col("part").alias("hay")),
                            ["g"], shortest=SHORTEST_NAME)
    equal = F.col("needle") == F.col("hay")
    inner = F.struct(F.col("needle").alias("p"), F.col("hay").alias("q"), F.lit(True).alias("inside"), equal.alias("around"))
    outer = F.struct(F.col("hay").alias("p"), F.col("needle").alias("q"), F.lit(False).alias("inside"), F.lit(True).alias("around"))
    both = F.when(equal, F.array(inner)).otherwise(F.array(inner, outer))
    return pairs.select("g", F.explode(both).alias("_l"), (F.length("needle") >= needle_floor(F.col("needle"))).alias("long")) \
        .select("g", "_l.*", "long")


def _meets(title: str, source: str, title_2: str, source_2: str) -> Column:
    """A row that shows p overlaps an earlier one that shows q: within a source
    by titles, across sources by any name."""
    own = F.col(title) & F.col(title_2) & F.col("long")
    other = F.col("inside") | (F.col("around") & (~F.col(title_2) | F.col("long")))
    return F.when(F.col(source) == F.col(source_2), own).otherwise(other)


def _verdicts(held: DataFrame, links: DataFrame) -> DataFrame:
    """(g, o, next, target, time, gives): what a round makes of every open row
    of ``held`` (g, o, source, part, title, time, state); ``gives`` says that
    the target takes the row's time."""
    first = held.groupBy("g", F.col("part").alias("q"), F.col("source").alias("s2"), F.col("title").alias("t2"),
                         "state", F.when(F.col("state") == KEPT, F.col("time")).otherwise("").alias("at")) \
        .agg(F.min("o").alias("e"))
    asks = ["g", "p", "s1", "t1", "time"]
    waiting = held.filter(F.col("state") == OPEN).select(
        "g", "o", F.col("part").alias("p"), F.col("source").alias("s1"), F.col("title").alias("t1"), "time")
    agrees = (F.col("at") == "") | (F.col("time") == "") | (F.col("at") == F.col("time"))
    seen = waiting.select(*asks).distinct().join(links, ["g", "p"]).join(first, ["g", "q"]) \
        .filter(_meets("t1", "s1", "t2", "s2") & agrees)
    best = seen.groupBy(*asks).agg(F.min(F.struct("e", "state", "at")).alias("best"))
    choice = waiting.join(best, asks, "left").groupBy("g", "o", "time").agg(F.min("best").alias("best")) \
        .withColumn("e", F.col("best.e"))
    # the first open row with a time that overlaps a kept row without one
    timed = waiting.filter("time <> ''").groupBy("g", "p", "s1", "t1").agg(F.min("o").alias("m"))
    blank = held.filter((F.col("state") == KEPT) & (F.col("time") == "")).select(
        "g", F.col("o").alias("e"), F.col("part").alias("q"), F.col("source").alias("s2"), F.col("title").alias("t2"))
    turn = blank.join(links, ["g", "q"]).join(timed, ["g", "p"]).filter(_meets("t1", "s1", "t2", "s2")) \
        .groupBy("g", "e").agg(F.min("m").alias("turn"))
    told = choice.join(turn, ["g", "e"], "left")
    free = F.col("e").isNull() | (F.col("e") >= F.col("o"))
    settled = (F.col("best.state") == KEPT) & ((F.col("time") == "") | (F.col("best.at") != "") | (F.col("turn") == F.col("o")))
    folds = ~free & F.coalesce(settled, F.lit(False))
    return told.select("g", "o", F.when(free, KEPT).when(folds, FOLDED).otherwise(OPEN).alias("next"),
                       F.when(folds, F.col("e")).alias("target"), "time",
                       (folds & (F.col("time") != "") & (F.col("best.at") == "")).alias("gives"))


def _after(held: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``held`` of groups with an open row left, without folded rows.  An open
    row has a verdict, a kept one may be given a time: no row has both."""
    moved = verdicts.select("g", "o", "next", F.lit(None).cast("string").alias("given"))
    given = verdicts.filter("gives").select("g", F.col("target").alias("o"), F.lit(None).cast("string").alias("next"),
                                            F.col("time").alias("given"))
    busy = verdicts.filter(F.col("next") == OPEN).select("g").distinct()
    return held.join(busy, "g", "left_semi").join(moved.unionByName(given), ["g", "o"], "left").select(
        "g", "o", "source", "part", "title", F.coalesce("given", "time").alias("time"), F.coalesce("next", "state").alias("state")) \
        .filter(F.col("state") != FOLDED)


def _fold_in_order(shown: pa.Table, links: pa.Table) -> pa.Table:
    """(g, o, target) of the folded rows of one group.  Per string, source and
    kind only the first kept row counts: of all, of each time, and of those
    still without one."""
    reach = defaultdict(list)
    for link in links.to_pylist():
        reach[link["p"]].append((link["q"], link["inside"], link["around"], link["long"]))
    rows = defaultdict(list)
    for row in shown.to_pylist():
        rows[tuple((v is not None, v) for v in row["o"].values())].append(row)  # nulls first, as in Spark
    order, times = sorted(rows), {}
    first, timed, blank, shows = defaultdict(dict), {}, defaultdict(list), {}
    out = []
    for o in order:
        time, best = rows[o][0]["time"], None
        for row in rows[o]:
            for q, inside, around, long in reach[row["part"]]:
                for (s2, t2), e in first[q].items():
                    if not (row["title"] and t2 and long if row["source"] == s2 else inside or (around and (not t2 or long))):
                        continue
                    if time:
                        waiting = blank[q, s2, t2]
                        while waiting and times[waiting[0]]:
                            waiting.pop(0)
                        e = min(filter(None, (timed.get((q, s2, t2, time)), *waiting[:1])), default=None)
                    if e is not None and (best is None or e < best):
                        best = e
        if best is None:
            times[o], shows[o] = time, [(row["part"], row["source"], row["title"]) for row in rows[o]]
            for q, s2, t2 in shows[o]:
                first[q].setdefault((s2, t2), o)
                if not time:
                    blank[q, s2, t2].append(o)
        else:
            out.append({"g": rows[o][0]["g"], "o": rows[o][0]["o"], "target": rows[best][0]["o"]})
        lead = o if best is None else best
        if time and (best is None or not times[best]):
            times[lead] = time
            for at in shows[lead]:
                timed[*at, time] = min(timed.get((*at, time), lead), lead)
    names = ["g", "o"]
    kind = pa.schema([*(shown.schema.field(n) for n in names), pa.field("target", shown.schema.field("o").type)])
    return pa.Table.from_pylist(out, schema=kind)


def first_fit(judged: DataFrame, in_order: int = IN_ORDER) -> DataFrame:
    """(lead, kept) for rows (g, lead, lead_ord, source, start_time, _parts)
    in order of (lead_ord, lead); a kept row is its own target.  An empty time
    is unknown."""
    rows = judged.select("g", F.struct("lead_ord", "lead").alias("o"), "source", F.coalesce("start_time", F.lit("")).alias("time"), "_parts")
    held = cut_lineage(rows.select("g", "o", "source", "time", F.explode("_parts").alias("_p"))
                       .select("g", "o", "source", F.col("_p.part").alias("part"), F.col("_p.is_title").alias("title"), "time"))
    links = cut_lineage(string_links(held))
    large = cut_lineage(held.select("g").unionByName(links.select("g")).groupBy("g").count().filter(F.col("count") > in_order).select("g"))
    if large.isEmpty():
        folded = _in_order(held, links)
    else:
        folded = _in_order(held.join(large, "g", "left_anti"), links.join(large, "g", "left_anti")).unionByName(
            _in_rounds(held.join(large, "g", "left_semi"), cut_lineage(links.join(large, "g", "left_semi"))))
    return rows.select("g", "o").join(folded, ["g", "o"], "left") \
        .select("o.lead", F.coalesce("target.lead", "o.lead").alias("kept"))


def _in_order(held: DataFrame, links: DataFrame) -> DataFrame:
    """(g, o, target) of folded rows, one group after another."""
    kind = held.select("g", "o", F.col("o").alias("target")).schema
    return held.groupBy("g").cogroup(links.groupBy("g")).applyInArrow(_fold_in_order, kind)


def _in_rounds(held: DataFrame, links: DataFrame) -> DataFrame:
    """(g, o, target) of folded rows, all groups together.

    A round is two small plans over stored tables, and later rounds see only
    groups that are still open, so neither the plans nor what the driver keeps
    of them grow with the rounds' joins."""
    held = cut_lineage(held.withColumn("state", F.lit(OPEN)))
    folder, rounds = f"{shared_folder(held.sparkSession)}/rounds-{uuid.uuid4().hex}", 0
    while True:
        verdicts = store(_verdicts(held, links), f"{folder}/round={rounds}")
        if verdicts.filter(F.col("next") == OPEN).isEmpty():
            break
        held, rounds = cut_lineage(_after(held, verdicts)), rounds + 1
    return held.sparkSession.read.schema(verdicts.schema).parquet(folder).filter(F.col("next") == FOLDED).select("g", "o", "target")

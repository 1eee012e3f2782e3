"""Mixing sources to target weights.

Every row gets a hash-random key; rows are range-sorted by (source, key), a
distributed prefix sum of sizes runs through each source, and the source is
cut at its exact budget.  A budget above the size of the source repeats it:
whole epochs first, then the cut in the last one.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, boxed, running_sums, stored

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
_WORD = re.compile(f"[^{SPACE}]+")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, share: float = 1.0) -> DataFrame:
    """``totals`` (source, source_size) with ``source_no`` and ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and
    share ``share`` of all sizes.  A target stops at ``most`` times its
    source; the rest is shared again by weight.  That ends at one common
    level t with target = min(cap, t * weight), found by sorting sources by
    cap per weight and summing along.  One row per source; the window runs
    over that table only.
    """
    one = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = totals.withColumn("source_no", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))).cast("long") - 1)
    rows = rows.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = one.orderBy((F.col("cap") / F.col("w")).asc(), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(one) * F.lit(float(share))
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                           / F.sum("w").over(onward))
    # the first source, in this order, whose cap is not reached sets the level
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"),
                         F.struct(F.col("cap") / F.col("w"), "source_no", "level"))).over(one)["level"]
    rows = rows.withColumn("t", level)
    return rows.select("source", "source_no", "source_size", F.when(
        F.col("t").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("t") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, most: int = MOST_EPOCHS,
        share: float = 1.0, tie: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``size`` defaults to the number of words (null text: 0).  ``taken`` is the
    number of words of that row in the mix: ``floor(budget / source_size)``
    whole epochs, and what the prefix sum leaves of the budget in the last.
    Budgets are targets rounded to whole words.  The order within a source is
    a hash of doc_id, then of source and text (or ``tie``), so reruns agree;
    rows equal in these are equal anyway.  Null doc_ids and sources are values like others; an empty table
    gives an empty result.  Words of a text of any length are counted whole.
    Columns other than doc_id, source and text are not returned.
    """
    size = word_count(docs["text"]) if size is None else size
    sized = stored(docs.select(
        "doc_id", "source", size.alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("key"),
        (row_tie("source") if tie is None else tie).alias("tie")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(totals, weights, most, share), "targets")
    back = targets.select(F.col("source").alias("_s"), "source_no", "source_size", "target")
    rows = sized.join(back, sized["source"].eqNullSafe(back["_s"])).drop("_s", "source")
    rows = running_sums(rows, "source_no", ["key", "doc_id", "tie"], "size", "prefix")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least("size", left - F.col("before")))
    return rows.select("doc_id", "tie", "size", "source_size", "target",
                       (epochs * F.col("size") + last).cast("long").alias("taken"))


def row_tie(*columns: str) -> Column:
    """Tells rows with one doc_id apart that differ in text or ``columns``;
    null differs from empty."""
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])) if columns else F.lit("")
    return F.md5(F.concat(others, F.lit(":"), F.coalesce(F.sha2("text", 256), F.lit("null"))))


def _first_words(texts: pa.Array, counts: pa.Array) -> pa.Array:
    out = []
    for text, n in zip(texts.to_pylist(), counts.to_pylist(), strict=True):
        ends = (m.end() for m in _WORD.finditer(text or ""))
        out.append(None if text is None else text[:next(islice(ends, n - 1, None), len(text))] if n > 0 else "")
    return pa.array(out, pa.string())


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of ``text`` with the white space between them."""
    return F.arrow_udf(_first_words, "string")(text, n)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row once per epoch that takes it.

    The one row that a source's budget cuts has, in its last epoch, its first
    words only.  Rows without words are in no mix.
    """
    tie = row_tie(*[c for c in docs.columns if c != "text"])
    found = mix(docs, tie=tie, **options).filter("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "size", "taken")
    # rows equal in all columns have one result together
    found = found.groupBy("_id", "_tie").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
    base = docs.select(boxed(docs, "text"), F.col("text"), tie.alias("_t"), F.col("doc_id").alias("_d"))
    repeated = base.groupBy("_d", "_t").count().filter("count > 1")
    if not repeated.isEmpty():
        base = base.dropDuplicates(["_d", "_t"])
    rows = base.join(found, base["_d"].eqNullSafe(found["_id"]) & (base["_t"] == found["_tie"]))
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("_epoch") - 1) * F.col("size"))
    # only the few texts that are cut go through Python
    rows = rows.withColumn("_cut", words < F.col("size")).withColumn("text", F.coalesce(first_words(F.when(F.col("_cut"), F.col("text")), words), F.col("text")))
    return rows.select("row.*", "text").select(*[f"`{c}`" for c in docs.columns])


"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes.  The distinct blocks are
sorted and numbered; then neighbouring numbers are paired and the distinct
pairs numbered in turn, until each document has one number.  Two documents
have the same number (of the same level) exactly when their bytes are equal:
no identity rests on a hash.  DataFrame operations only.

Whole blocks are shuffled once, to find the distinct ones.  Rows then find the
number of their block by its 128-bit digest.  That is exact because the
distinct blocks are at hand: if two of them share a digest the digest gets
another seed and the naming starts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, stored

BLOCK_BYTES = 4096


def _digest(col: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), col).alias("d1"), F.xxhash64(F.lit(2 * seed + 1), col).alias("d2")]


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Sorted numbers: (range, place in it) in one long."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, row_key, level, name) for every distinct (doc_id, text) of ``docs``.

    A null text counts as empty; a null doc_id is a value like others.  Rows
    that share a doc_id are told apart by ``row_key``, a digest of the text,
    so repeated rows get one identity and different texts two.
    """
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    source = docs.select("doc_id", text_key().alias("row_key"), body.alias("body"))
    last = F.greatest(F.ceil(F.length("body") / F.lit(block_bytes)) - 1, F.lit(0)).cast("int")
    blocks = source.select(
        "doc_id", "row_key",
        F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(
            F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))).alias("i", "block"))
    seed = 0
    while True:
        names = stored(_named(blocks.select("block").distinct(), "block").select(
            *_digest(F.col("block"), seed), "name"), "blocks")
        if names.groupBy("d1", "d2").count().filter("count > 1").isEmpty():
            break
        seed += 1
    rows = blocks.select("doc_id", "row_key", "i", *_digest(F.col("block"), seed)) \
        .join(names, ["d1", "d2"]).select("doc_id", "row_key", "i", "name")
    rows = stored(rows, "named")
    longest = rows.agg(F.max("i")).first()[0] or 0
    done, level, keys = [], 0, ["doc_id", "row_key"]
    while True:
        # a document is done when its only block of this level is block 0
        width = rows.groupBy(*keys).agg(F.max("i").alias("top"))
        ended = width.filter("top = 0").select(*keys)
        whole = rows.join(ended, _same(rows, ended), "left_semi") if longest else rows
        done.append(whole.select(*keys, F.lit(level).alias("level"), "name"))
        if not longest:
            break
        going = width.filter("top > 0").select(*keys)
        pairs = rows.join(going, _same(rows, going), "left_semi").groupBy(
            *keys, F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = stored(pairs, "pairs")
        names = stored(_named(pairs.select("a", "b").distinct(), "a", "b"), "pairnames")
        rows = stored(pairs.join(names, ["a", "b"]).select(*keys, "i", "name"), "named")
        longest, level = longest // 2, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return stored(out.distinct(), "identity")


def text_key() -> Column:
    """Tells rows with one doc_id apart."""
    return F.xxhash64(F.lit(-7), F.coalesce("text", F.lit("")))


def _same(x: DataFrame, y: DataFrame):
    return x["doc_id"].eqNullSafe(y["doc_id"]) & (x["row_key"] == y["row_key"])


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, row_key, own, keep_id, group_size.

    Of equal texts the largest doc_id is kept; null is smaller than any id.
    ``group_size`` counts rows of ``docs``, repeated ones too; ``own`` those
    with this doc_id.
    """
    ids = identities(docs, block_bytes)
    counts = docs.select("doc_id", text_key().alias("row_key")).groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("n"))
    ids = ids.join(counts, _same(ids, counts)).select(ids["doc_id"], ids["row_key"], "level", "name", "n")
    ids = stored(ids, "counted")
    groups = ids.groupBy("level", "name").agg(
        F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = stored(groups, "groups")  # on its own, so that a join on a hot identity can be split
    return ids.join(groups, ["level", "name"]).select("doc_id", "row_key", F.col("n").alias("own"), "keep_id", "group_size")


def mark_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256.

    Every row gets a result.  Repeated rows of the kept doc_id are all kept
    rows here; ``drop_duplicates`` leaves one of them.  Null texts count as
    empty; null doc_ids come before all others.  Texts of any length are cut
    into blocks, whole.  An empty table gives no rows.  Columns of ``docs``
    with these names are replaced; others travel as one struct, so none
    clashes.
    """
    base = docs.select(boxed(docs, "keep_id", "group_size", "kept", "text_sha256"), F.col("doc_id").alias("_id"),
                       text_key().alias("_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    found = exact_duplicates(docs.select("doc_id", "text"), block_bytes)
    out = base.join(found, base["_id"].eqNullSafe(found["doc_id"]) & (base["_key"] == found["row_key"]))
    return out.select("row.*", "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without copies: of equal texts the row with the largest doc_id
    stays (of repeated rows of that id, one)."""
    found = exact_duplicates(docs.select("doc_id", "text"), block_bytes)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "row_key", "own")
    base = docs.select(boxed(docs), F.col("doc_id").alias("_id"), text_key().alias("_key"))
    rows = base.join(keep, base["_id"].eqNullSafe(keep["doc_id"]) & (base["_key"] == keep["row_key"]))
    # only a kept id that comes with the same text again has rows to choose from
    once, again = rows.filter("own = 1"), rows.filter("own > 1")
    if not keep.filter("own > 1").isEmpty():
        once = once.unionByName(again.dropDuplicates(["_id", "_key"]))
    return once.select("row.*")

"""Exact substring join without comparing all pairs.

A needle lies inside a hay only if every three-character piece of it does, so
each needle is looked up under one piece only, the one that fewest strings
hold.  Pieces are counted once over the distinct strings of all groups, which
also tells how heavy a piece is: the postings of a heavy one are split into
parts by hash, and its needles are asked of every part.

Hays give up only the pieces some needle is looked up under, before anything
is shuffled, and both sides meet on a 64-bit hash of (group, piece, part).  A
hash alone decides nothing: group and text are compared again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.session import cut_lineage, sized_broadcast

#: characters of a piece
PIECE = 3
#: strings one part of a piece's postings holds, about
POSTINGS = 10_000


def pieces(text: Column, size: int = PIECE) -> Column:
    """Distinct substrings of ``size`` characters."""
    starts = F.when(F.length(text) >= size,
                    F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.array_distinct(F.transform(
        F.coalesce(starts, F.array().cast("array<int>")),
        lambda i: F.substring(text, i, F.lit(size))))


def postings(texts: DataFrame, text: str, size: int) -> DataFrame:
    """``texts`` once per distinct piece, ``_piece``.  Cut one by one and kept
    where they come first, which stays inside generated code."""
    cut = texts.filter(F.length(text) >= size).withColumn(
        "_i", F.explode(F.sequence(F.lit(1), F.length(text) - (size - 1))))
    cut = cut.withColumn("_piece", F.substring(F.col(text), F.col("_i"), F.lit(size)))
    return cut.filter(F.call_function("instr", F.col(text), F.col("_piece")) == F.col("_i")).drop("_i")


def rare_pieces(needles: DataFrame, hays: DataFrame, size: int, heavy: int = POSTINGS) -> DataFrame:
    """(needle, _piece, _parts): for each distinct needle all of whose pieces
    occur in some hay, the piece that fewest of them hold."""
    held = postings(hays.distinct(), "hay", size).groupBy("_piece").agg(F.count(F.lit(1)).alias("_hays"))
    asked = needles.distinct().withColumn("_all", pieces(F.col("needle"), size)) \
        .select("needle", F.size("_all").alias("_of"), F.explode("_all").alias("_piece"))
    return asked.join(held, "_piece").groupBy("needle", "_of").agg(
        F.min(F.struct("_hays", "_piece")).alias("_rare"), F.count(F.lit(1)).alias("_found")) \
        .filter(F.col("_found") == F.col("_of")) \
        .select("needle", F.col("_rare._piece").alias("_piece"),
                F.ceil(F.col("_rare._hays") / heavy).cast("int").alias("_parts"))


def contained_pairs(needles: DataFrame, hays: DataFrame, group: Sequence[str],
                    needle: str = "needle", hay: str = "hay", size: int = PIECE,
                    shortest: int = PIECE, heavy: int = POSTINGS) -> DataFrame:
    """Distinct (group, needle, hay) with the needle inside the hay of the
    same group; null groups are equal.  Needles shorter than ``shortest`` are
    not searched for; one shorter than ``size`` is a piece itself."""
    group = list(group)
    wanted = needles.select(*group, F.col(needle).alias("needle")).distinct()
    texts = hays.select(*group, F.col(hay).alias("hay")).distinct()
    found = None
    for length in range(shortest, size + 1):
        fit = F.length("needle") >= size if length == size else F.length("needle") == length
        pairs = _pairs(wanted.filter(fit), texts, group, length, heavy)
        found = pairs if found is None else found.unionByName(pairs)
    return found.withColumnsRenamed({"needle": needle, "hay": hay})


def _pairs(wanted: DataFrame, texts: DataFrame, group: list[str], size: int, heavy: int) -> DataFrame:
    # read three times below
    rare = cut_lineage(rare_pieces(wanted.select("needle"), texts.select("hay"), size, heavy))
    # a piece is as heavy for all of its needles
    looked_up = sized_broadcast(rare.select("_piece", "_parts").distinct())

    def key(part: Column) -> Column:
        return F.xxhash64(*[F.col(g) for g in group], F.col("_piece"), part)

    asked = wanted.join(rare, "needle")
    asked = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))) \
        .select(*[F.col(g).alias(f"_n_{g}") for g in group], "needle", key(F.col("_part")).alias("_key"))
    held = postings(texts, "hay", size).join(looked_up, "_piece")
    held = held.select(*group, "hay", key(F.pmod(F.xxhash64("hay"), F.col("_parts")).cast("int")).alias("_key"))
    same = F.contains(F.col("hay"), F.col("needle"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_n_{g}"))
    return held.join(asked, "_key").filter(same).select(*group, "needle", "hay")

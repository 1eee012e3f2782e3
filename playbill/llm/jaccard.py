"""N-gram Jaccard join by token-combination prefixes.

A document is its set of word n-grams (tokens).  Tokens have one order: rare
ones first, then frequent ones, each by hash.  If a pair reaches the
similarity, each lacks at most ``t`` tokens of the other, so their prefixes
share a signature:

* a rare token is a signature by itself; ``t + 1`` of them make a prefix;
* frequent tokens are dealt into groups by hash, and two of one group make a
  signature.  A group of ``c`` tokens counts ``c - 1`` only, so the prefix is
  extended until rare tokens and groups add up to ``t + 1``.

Whether a token is frequent is read off a bit map of hash slots: any function
of the token serves, as long as all documents use the same.

The smaller of a pair lacks only about half as many, so its prefix may be as
much shorter.  Every document has both: a pair counts where the smaller one's
short prefix meets the other's long one, and signatures that are in no short
prefix fall away.  Thousands of copies of one text that differ from each other
by more than the radius meet nowhere then, since what is their own fills their
short prefixes.

Signatures with a single document fall away too.  Of the others, members are first
verified against the smallest id, then against the members with most links so
far, so a group of thousands of copies costs thousands of pairs.  Groups that
one component covers are done.  What is left to compare are members of
different components.  Those near the smallest member are known by what they
do not share with it, and two of them are similar only if these differences
are: they are compared like sets of their own, by prefixes of their rarest
tokens, and decided without their texts.  For the others the triangle
inequality of Jaccard distance leaves only pairs whose distances to the
smallest member differ by no more than the radius.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, discard, give_back, stored
from .grams import Words, mixed, slices, windows

WIDTH, PERCENT = 5, 80
SLOT_BITS = 30
#: documents that may share a slot before its tokens count as frequent
FREQUENT = 32
#: frequent tokens per group, in a document that has no others
PER_GROUP = 64
#: members every open group is compared with, after the smallest
PIVOTS = 2
#: differences that are kept, as a share of both sets together
KEPT = 0.4
#: sets apart the signatures of single tokens
_ALONE = np.uint64(0x1234567)


def token_sets(texts: pa.Array, width: int):
    """Sorted distinct tokens (unsigned 64-bit) of every text, in order."""
    for _, data, off in slices(texts):
        words = Words(data, off, lower=True)
        at = words.upto
        line = words.hashes()
        grams = windows(line, width)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(grams[a:b - width + 1])
            elif b > a:
                yield windows(line[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def lacking(n: int, percent: int) -> int:
    """Most tokens of a set of ``n`` that a similar set can lack."""
    return n - -(-n * percent // 100)


def lacking_smaller(n: int, percent: int) -> int:
    """Most tokens of a set of ``n`` that a similar set of ``n`` or more lacks."""
    return n - -(-2 * n * percent // (100 + percent))


def slot(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def band(n: int, percent: int) -> int:
    """Similar sets are in the same band of sizes or in neighbouring ones."""
    return int(np.floor(np.log(n) / -np.log(percent / 100) + 1e-9))


def signatures(tokens: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set's short prefix, and the others of its long one;
    ``hot`` says which of its tokens are frequent.  Sets of one token have
    none: only an equal set is similar."""
    n = len(tokens)
    if n < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    few, many = lacking_smaller(n, percent) + 1, lacking(n, percent) + 1
    rare = tokens[~hot]
    if len(rare) >= many:  # most sets: no frequent token is in either prefix
        found = mixed(rare[:many] ^ _ALONE)
        return found[:few], found[few:]
    short, long = (np.unique(_prefix_signatures(tokens, hot, percent, need)) for need in (few, many))
    return short, np.setdiff1d(long, short, assume_unique=True)


def _prefix_signatures(tokens: np.ndarray, hot: np.ndarray, percent: int, need: int) -> np.ndarray:
    n = len(tokens)
    rare, often = tokens[~hot], tokens[hot]
    found = [mixed(rare[:need] ^ _ALONE)]
    need -= len(rare)
    if need > 0:
        own = band(n, percent)
        for b in (own, own + 1):
            groups = max(1, int((100 / percent) ** b) // PER_GROUP)
            group = (mixed(often + np.uint64(77)) % np.uint64(groups)).astype(np.int64)
            later = np.ones(len(often), bool)
            later[np.unique(group, return_index=True)[1]] = False
            end = int(np.searchsorted(np.cumsum(later), need)) + 1
            t, g = often[:end], group[:end]
            order = np.argsort(g, kind="stable")
            t, g = t[order], g[order]
            count = np.bincount(g, minlength=groups)[g]
            first = np.searchsorted(g, g)
            ahead = first + count - 1 - np.arange(len(g))  # members of its group behind each
            i = np.repeat(np.arange(len(g)), ahead)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
            found.append(mixed(mixed(t[i]) * np.uint64(3) + mixed(t[j]) * np.uint64(5) + np.uint64(b)))
    return np.concatenate(found)


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    sizes = np.array([0, *map(len, arrays)], np.int64)
    flat = np.concatenate([np.zeros(0, kind), *[a.view(kind) for a in arrays]])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat))


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, n, d1, d2, slots): size and 128-bit digest of each set, and the
    slots of the prefix it would have if no token were frequent."""
    def work(texts: pa.Array) -> pa.Array:
        n, d1, d2, slots = [], [], [], []
        for tokens in token_sets(texts, width):
            n.append(len(tokens))
            d1.append(int(tokens.sum(dtype=np.uint64).astype(np.int64)))
            d2.append(int(mixed(tokens).sum(dtype=np.uint64).astype(np.int64)))
            slots.append(slot(tokens[:lacking(len(tokens), percent) + 1]).astype(np.int32))
        give_back()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                                           _lists(slots, np.int32)], ["n", "d1", "d2", "slots"])

    kind = "n long, d1 long, d2 long, slots array<int>"
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.arrow_udf(work, kind)("text").alias("r"))
    return stored(rows.select("id", "r.*"), "profiles")


def frequent_slots(found: DataFrame) -> tuple[np.ndarray, int]:
    """Bit map of slots with many prefix tokens, and the bits a slot number
    is shortened by.  There are about as many slots as prefix tokens, at most
    2**SLOT_BITS."""
    total = found.agg(F.sum(F.size("slots"))).first()[0] or 0
    bits = min(SLOT_BITS, max(10, int(total).bit_length()))
    least = max(FREQUENT, 8 * total >> bits)
    counts = found.select(F.explode("slots").alias("s")).select(
        F.shiftright("s", SLOT_BITS - bits).alias("s")).groupBy("s").count()
    hot = counts.filter(F.col("count") > least).select("s").toArrow()["s"].to_numpy()
    out = np.zeros(1 << (bits - 3), np.uint8)
    np.bitwise_or.at(out, hot >> 3, np.left_shift(1, hot & 7).astype(np.uint8))
    return out, SLOT_BITS - bits


def signature_rows(docs: DataFrame, frequent: np.ndarray, shift: int, width: int, percent: int) -> DataFrame:
    """(id, short, long) of every document with an id: signatures of its short
    prefix, and the others of its long one."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent.tobytes())

    def work(texts: pa.Array) -> pa.Array:
        bits = np.frombuffer(shared.value, np.uint8)
        short, long = [], []
        for tokens in token_sets(texts, width):
            s = slot(tokens) >> shift
            a, b = signatures(tokens, (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1, percent)
            short.append(a)
            long.append(b)
        give_back()
        return pa.StructArray.from_arrays([_lists(short, np.int64), _lists(long, np.int64)], ["short", "long"])

    found = F.arrow_udf(work, "short array<long>, long array<long>")("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), found.alias("r")).select("id", "r.*")
    return stored(rows.filter(F.col("id").isNotNull() & (F.size("short") > 0)), "signatures")


def _overlap(width: int, kept: float):
    """Sizes of two sets, the number of their common tokens, and the others if
    they are at most the share ``kept``."""
    def sets(texts: pa.Array):
        """Token sets of a column; a text that comes again is read once."""
        kinds = texts.dictionary_encode(null_encoding="encode")
        found = list(token_sets(kinds.dictionary, width))
        return (found[k] for k in kinds.indices.to_pylist())

    def work(left: pa.Array, right: pa.Array) -> pa.Array:
        rows = []
        for at in range(0, len(left), 128):  # few sets in memory at a time
            for x, y in zip(sets(left.slice(at, 128)), sets(right.slice(at, 128)), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                near = len(x) + len(y) - 2 * common <= kept * (len(x) + len(y))
                rows.append((len(x), len(y), common, np.setxor1d(x, y, assume_unique=True).view(np.int64) if near else None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64()))],
                                          ["n_a", "n_b", "common", "delta"])
    return work


def verified(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, width: int, percent: int, kept: float = -1.0) -> DataFrame:
    """``pairs`` (a, b) with both sizes, the number of shared tokens, and the
    tokens not shared (``delta``) where they are at most the share ``kept``.
    Pairs whose sizes rule the similarity out are dropped first.

    Texts travel, which take half the room of their sets."""
    a, b = (sizes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    fit = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    pairs = pairs.join(a, "a").join(b, "b").filter(fit).select("a", "b").distinct()
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b") \
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    out = F.arrow_udf(_overlap(width, kept), "n_a long, n_b long, common long, delta array<long>")("ta", "tb")
    return stored(both.select("a", "b", out.alias("r")).select("a", "b", "r.*"), "verified")


def delta_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of different components near one pivot.

    ``members`` is (p, id, c, n, delta): ``delta`` are the tokens that the set
    of ``id`` and that of ``p`` do not share.  Of two similar sets together
    ``D`` tokens are not shared, and as their components differ, not both are
    linked with p, so their deltas meet.  The shorter delta lacks at most
    D / 2 tokens of the other, so one of its D / 2 + 1 rarest is in it.  What
    both deltas do not share is what both sets do not share.
    """
    members = stored(members, "deltas")
    each = members.select("p", "id", F.explode("delta").alias("t"))
    times = stored(each.groupBy("p", "t").count().filter("count > 1"), "times")
    held = stored(each.join(times, ["p", "t"]), "held")  # tokens of one delta alone meet nothing
    size = members.select("p", "id", "c", "n", F.size("delta").alias("m"))
    # D of a set of n and one of n * 100 / percent tokens, the largest that can be similar
    most = F.floor((100 - percent) * F.col("n") / percent)
    alone = F.col("m") - F.col("shared")
    short = held.groupBy("p", "id").agg(F.sort_array(F.collect_list(F.struct("count", "t"))).alias("o"), F.count(F.lit(1)).alias("shared")) \
        .join(size, ["p", "id"]).withColumn("left", F.floor(most / 2) + 1 - alone).filter("left > 0") \
        .select("p", "id", "c", "n", "m", F.explode(F.slice("o", F.lit(1), F.greatest("left", F.lit(1)).cast("int"))).alias("o"))
    x = short.select("p", F.col("o.t").alias("t"), F.col("id").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("m").alias("mx"))
    y = held.join(size, ["p", "id"]).select("p", "t", F.col("id").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("m").alias("my"))
    fit = (F.col("cx") != F.col("cy")) & (F.col("mx") <= F.col("my")) & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
    pairs = stored(x.join(y, ["p", "t"]).filter(fit).select("p", "x", "y", "nx", "ny").distinct(), "met")
    dx, dy = (members.select("p", F.col("id").alias(k), F.col("delta").alias(f"d{k}")) for k in "xy")
    both = pairs.join(dx, ["p", "x"]).join(dy, ["p", "y"])
    apart = F.size("dx") + F.size("dy") - 2 * F.size(F.array_intersect("dx", "dy"))
    common = (F.col("nx") + F.col("ny") - apart) / 2
    return stored(both.filter(common * 100 >= (F.col("nx") + F.col("ny") - common) * percent).select(
        F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")


def relabelled(label: DataFrame, new: DataFrame) -> DataFrame:
    """Components (node, root) after the links ``new`` (a, b).  Only roots that
    the new links join are looked at again."""
    a, b = (label.select(F.col("node").alias(k), F.col("root").alias(f"r_{k}")) for k in "ab")
    joined = new.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b")).filter("a <> b").distinct()
    joined = stored(joined, "joined")
    if joined.isEmpty():
        return label
    top = stored(connected(joined, "edges"), "tops")
    moved = label.join(top.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left") \
        .select("node", F.coalesce("_to", "root").alias("root"))
    return stored(moved.unionByName(top.join(label, "node", "left_anti")), "labels")


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sets, labels): profiles of all rows, and the component (node, root) of
    every document that a similar pair holds."""
    rows = profiles(docs, width, percent)
    found = stored(rows.drop("slots"), "sizes")
    frequent, shift = frequent_slots(rows)
    discard(rows)
    sizes = found.filter("id is not null and n > 0").distinct()
    # equal sets: linked to the smallest id, and not verified
    first = sizes.groupBy("n", "d1", "d2").agg(F.min("id").alias("b"))
    copies = stored(sizes.join(first, ["n", "d1", "d2"]).filter("id > b").select(F.col("id").alias("a"), "b"), "copies")
    sigs = signature_rows(docs, frequent, shift, width, percent)
    members = sigs.select("id", F.explode("short").alias("sig"), F.lit(True).alias("small")).unionByName(
        sigs.select("id", F.explode("long").alias("sig"), F.lit(False).alias("small")))
    pivots = members.groupBy("sig").agg(F.min("id").alias("p"), F.max("id").alias("last"), F.bool_or("small").alias("small")) \
        .filter("p < last and small")
    pivots = stored(pivots, "pivots")  # on its own, so that a join on a hot signature can be split
    # copies have all signatures of their first, so no pivot is a copy
    grouped = members.join(pivots.select("sig", "p"), "sig")
    grouped = grouped.join(copies.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    # an id with several texts may have a signature in either prefix
    grouped = stored(grouped.groupBy("sig", "p", "id").agg(F.bool_or("small").alias("small")), "grouped")
    discard(sigs)
    asked = grouped.select("id").distinct()
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(asked, "id"), "texts")
    discard(pivots)
    linked = F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent
    near = verified(grouped.filter("id > p").select(F.col("p").alias("a"), F.col("id").alias("b")).distinct(),
                    texts, sizes, width, percent, KEPT)
    deltas = near.filter("delta is not null").select(F.col("a").alias("p"), F.col("b").alias("id"), "delta")
    near = near.drop("delta")
    edges = near.filter(linked).select("a", "b").unionByName(copies)
    used = grouped.select("sig", F.col("p").alias("id")).distinct()
    label = stored(connected(edges, "edges"), "labels")
    for more_pivots in (True,) * PIVOTS + (False,):
        # groups that one component covers are done
        state = grouped.join(label.withColumnsRenamed({"node": "id", "root": "c"}), "id", "left") \
            .withColumn("c", F.coalesce("c", "id"))
        open_ = stored(state.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("sig"), "open")
        if open_.isEmpty():
            return found, label
        state = stored(state.join(open_, "sig"), "state")
        if not more_pivots:
            break
        # the member with most links so far is the likely centre of its copies
        ends = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("id")).count()
        free = state.join(used, ["sig", "id"], "left_anti").join(ends, "id", "left")
        best = stored(free.groupBy("sig").agg(F.max(F.struct(F.coalesce("count", F.lit(0)), -F.col("id"), "id", "c")).alias("q"))
                      .select("sig", F.col("q.id").alias("q"), F.col("q.c").alias("cq")), "pivots")
        pairs = state.join(best, "sig").filter("c <> cq").select(
            F.least("id", "q").alias("a"), F.greatest("id", "q").alias("b")).distinct()
        found_now = verified(pairs.join(near.select("a", "b"), ["a", "b"], "left_anti"), texts, sizes, width, percent)
        near = near.unionByName(found_now.drop("delta"))
        new = found_now.filter(linked).select("a", "b")
        edges, label = edges.unionByName(new), relabelled(label, new)
        used = used.unionByName(best.select("sig", F.col("q").alias("id")))
    apart = 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    distance = near.groupBy(F.col("a").alias("p"), F.col("b").alias("id")).agg(F.min(apart).alias("d"))
    # sizes alone keep a pair that was dropped unverified beyond any radius
    radius = 1 - percent / 100
    rest = state.join(distance, ["p", "id"], "left").withColumn(
        "d", F.when(F.col("id") == F.col("p"), 0.0).otherwise(F.col("d")))
    # an id with several texts is at no one distance: each of its sizes counts, and no triangle holds
    several = stored(sizes.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("_many")), "several")
    rest = rest.join(sizes.select("id", "n").distinct(), "id").filter("id <> p").join(several, "id", "left") \
        .join(several.withColumnsRenamed({"id": "p", "_many": "_many_p"}), "p", "left")
    one = F.col("_many").isNull() & F.col("_many_p").isNull()
    rest = rest.withColumn("d", F.when(one, F.col("d"))).drop("_many", "_many_p") \
        .join(deltas.select("p", "id", F.lit(True).alias("_near")), ["p", "id"], "left")
    rest = stored(rest.withColumn("k", F.col("_near").isNotNull() & F.col("d").isNotNull()).drop("_near"), "rest")
    by_delta = delta_links(rest.filter("k").select("p", "id", "c", "n").distinct().join(deltas, ["p", "id"]), percent)
    label = relabelled(label, by_delta)
    shell = F.floor(F.col("d") / radius)
    known = rest.filter("d is not null").withColumn("shell", shell)
    unknown = rest.filter("d is null")
    # a pair has one member at least outside the ball round the pivot
    u = known.filter(F.col("d") > radius - 1e-9).select(
        "sig", F.explode(F.array(F.col("shell") - 1, F.col("shell"), F.col("shell") + 1)).alias("shell"),
        F.col("id").alias("u"), F.col("c").alias("cu"), F.col("d").alias("du"), F.col("n").alias("nu"), F.col("small").alias("su"),
        F.col("k").alias("ku"))
    v = known.select("sig", "shell", F.col("id").alias("v"), F.col("c").alias("cv"), F.col("d").alias("dv"), F.col("n").alias("nv"),
                     F.col("small").alias("sv"), F.col("k").alias("kv"))
    fit = (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent) & (F.col("cu") != F.col("cv"))
    fit = fit & ((F.col("su") & (F.col("nu") <= F.col("nv"))) | (F.col("sv") & (F.col("nv") <= F.col("nu"))))
    close = fit & (F.abs(F.col("du") - F.col("dv")) <= radius + 1e-9)
    # the smaller of a pair has the signature in its short prefix: one side of each join holds such rows only
    def met(u, v):
        return u.filter("su").join(v, ["sig", "shell"]).filter(close).select("u", "v").unionByName(
            u.filter("not su").join(v.filter("sv"), ["sig", "shell"]).filter(close).select("u", "v"))

    # members near their pivot have been compared with each other
    more = met(u.filter("not ku"), v).unionByName(met(u.filter("ku"), v.filter("not kv")))
    # members whose size differs too much from the pivot's have no distance
    u2 = unknown.select("sig", F.col("id").alias("u"), F.col("c").alias("cu"), F.col("n").alias("nu"), F.col("small").alias("su"))
    v2 = rest.select("sig", F.col("id").alias("v"), F.col("c").alias("cv"), F.col("n").alias("nv"), F.col("small").alias("sv"))
    step = -np.log(percent / 100)

    def banded(df, n, spread):
        b = F.floor(F.log(n) / F.lit(float(step)))
        return df.withColumn("k", F.explode(F.array(b - 1, b, b + 1)) if spread else b)

    far = banded(u2.filter("su"), "nu", True).join(banded(v2, "nv", False), ["sig", "k"]).filter(fit).select("u", "v").unionByName(
        banded(u2.filter("not su"), "nu", True).join(banded(v2.filter("sv"), "nv", False), ["sig", "k"]).filter(fit).select("u", "v"))
    more = more.unionByName(far)
    more = more.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).filter("a < b").distinct()
    more = stored(more.join(near.select("a", "b"), ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        label = relabelled(label, verified(more, texts, sizes, width, percent).filter(linked).select("a", "b"))
    return found, label


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when 100 * common >= percent * union of their sets of
    ``width`` words (A-Z in lower case); a shorter text is one gram.  Without
    words the set is empty and links with nothing.  ``component_id`` is the
    smallest doc_id reachable.  Rows that share a doc_id are one document with
    several texts; rows without doc_id link with nothing and have no component.
    Texts of any length are read whole; an empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50..100")
    found, label = components(docs, width, percent)
    roots = label.withColumnRenamed("node", "id")
    rows = found.select("id", "n").join(roots, "id", "left")
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                       F.coalesce("root", "id").alias("component_id"))


def one_per_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id with
    all its rows.  Rows without doc_id stay."""
    gone = near_groups(docs.select("doc_id", "text"), width, percent).filter("doc_id <> component_id").select(
        F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")

"""Modified Kneser-Ney model of byte n-grams, counted by Spark.

A gram of ORDER bytes is packed into one integer, so no two grams are taken
for one another.  Tasks count grams of their texts and send distinct ones only;
orders below the highest count the distinct bytes before a gram.  Of a gram
the model holds its discounted share of its context, of a context the weight
it passes on to the next lower order; both are found in one array sorted by
hash.

The model grows with the corpus, so no task holds all of it: everything that
the probability of a byte needs is dealt by the two bytes before it, and texts
are scored against one shard of the model after another.  A shard has at most
SHARD entries (one pair of bytes has at most 256**3 grams); logarithms of all
shards add up to that of the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored
from .grams import mixed, slices

ORDER = 5
#: entries of one shard, 12 bytes each
SHARD = 8_000_000
#: distinct grams a task holds before it sends them, and scores it remembers
HELD = 2_000_000
#: bytes of text worked on at a time
TEXT = 1 << 21
_PAIRS = 1 << 16


def packed(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram that ends at each byte of a slice.  Zero bytes stand before
    the first byte of a text."""
    wide = data.astype(np.int64)
    out = wide.copy()
    for back in range(1, order):
        out[back:] |= wide[:len(wide) - back] << (8 * back)
    for room in range(order - 1):
        at = off[:-1][np.diff(off) > room] + room
        out[at] &= (1 << 8 * (room + 1)) - 1
    return out


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])[:len(k)])
    return k[first], np.add.reduceat(c, first) if len(first) else c


def gram_counts(docs: DataFrame, order: int = ORDER, held: int = HELD) -> DataFrame:
    """Stored (g, c): every gram of ``order`` bytes of all texts, counted."""
    def work(batches):
        k, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, data, off in slices(batch["text"], TEXT):
                found, n = np.unique(packed(data, off, order), return_counts=True)
                k, c = _merged([k, found], [c, n])
                if len(k) > held:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["g", "c"])
                    k, c = k[:0], c[:0]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["g", "c"])

    rows = docs.select("text").mapInArrow(work, "g long, c long")
    return stored(rows.groupBy("g").agg(F.sum("c").alias("c")), "grams")


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """What is taken from counts of one, two, three and more, given how many
    grams have a count of one to four.  Without grams of a count the discount
    is three quarters."""
    n1, n2 = n.get(1, 0), n.get(2, 0)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = []
    for j in (1, 2, 3):
        a, b = n.get(j, 0), n.get(j + 1, 0)
        out.append(min(max(j - (j + 1) * y * b / a, 0.1), float(j)) if a else 0.75)
    return tuple(out)


def entries(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Stored rows (pair, kind, key, value) of the model.  ``kind`` is k for
    shares of grams of k bytes, and 8 + k for weights of their contexts;
    ``pair`` is the last two bytes of the context, null for k < 3."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        suffix = F.col("g").bitwiseAND((1 << 8 * k) - 1)
        levels[k] = stored(levels[k + 1].groupBy(suffix.alias("g")).agg(F.count(F.lit(1)).alias("c")), "grams")
    grams = None
    for k, rows in levels.items():
        rows = rows.select(F.lit(k).alias("k"), "g", "c")
        grams = rows if grams is None else grams.unionByName(rows)
    few = grams.filter("c <= 4").groupBy("k", "c").count().collect()  # four rows an order
    taken = {k: discounts({r["c"]: r["count"] for r in few if r["k"] == k}) for k in levels}
    off = F.create_map(*[F.lit(v) for k, d in taken.items() for v in (k, F.array(*map(F.lit, d)))])
    # a context has at most 256 grams
    w = Window.partitionBy("k", "h")
    kind = F.least("c", F.lit(3)).cast("int")
    grams = grams.withColumns({"h": F.shiftright("g", 8), "less": off[F.col("k")][kind - 1]})
    grams = grams.withColumns({"all": F.sum("c").over(w), "rest": F.sum("less").over(w), "first": F.min("g").over(w) == F.col("g")})
    pair = F.when(F.col("k") >= 3, F.col("h").bitwiseAND(_PAIRS - 1)).cast("int").alias("pair")
    share = F.struct(F.col("k").alias("kind"), F.col("g").alias("key"), ((F.col("c") - F.col("less")) / F.col("all")).cast("float").alias("value"))
    weight = F.struct((F.col("k") + 8).alias("kind"), F.col("h").alias("key"), (F.col("rest") / F.col("all")).cast("float").alias("value"))
    both = F.explode(F.when(F.col("first"), F.array(share, weight)).otherwise(F.array(share)))
    out = stored(grams.select(pair, both.alias("e")).select("pair", "e.*"), "model")
    discard(*levels.values())
    return out


def hashed(kind, key: np.ndarray) -> np.ndarray:
    """One to one, so equal hashes are equal entries."""
    return mixed(key.astype(np.uint64) | (np.asarray(kind).astype(np.uint64) << np.uint64(48)))


@dataclass
class Shard:
    """Entries sorted by hash, and the pairs of bytes they serve."""
    hashes: np.ndarray
    values: np.ndarray
    pairs: np.ndarray
    order: int

    def __post_init__(self):
        self.known, self.logs = np.zeros(0, np.int64), np.zeros(0)

    def value(self, kind: int, key: np.ndarray, other: float) -> np.ndarray:
        h = hashed(kind, key)
        order = np.argsort(h)
        at = np.minimum(np.searchsorted(self.hashes, h[order]), max(len(self.hashes) - 1, 0))
        out = np.full(len(key), other)
        if len(self.hashes):
            out[order] = np.where(self.hashes[at] == h[order], self.values[at], other)
        return out

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Of the last byte of each distinct gram, given the others."""
        p = np.full(len(grams), 1 / 256)
        for k in range(1, self.order + 1):
            own = grams & ((1 << 8 * k) - 1)
            p = self.value(k, own, 0.0) + self.value(8 + k, own >> 8, 1.0) * p
        return np.log(p)

    def sums(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Sum of logarithms of each text's bytes that this shard serves."""
        if len(self.known) > HELD:
            self.known, self.logs = self.known[:0], self.logs[:0]
        grams = packed(data, off, self.order)
        kinds, back = np.unique(grams, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, kinds), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != kinds) if len(self.known) else np.arange(len(kinds))
        if len(new):
            mine = self.pairs[(kinds[new] >> 8) & (_PAIRS - 1)]
            logs = np.zeros(len(new))
            logs[mine] = self.log_probability(kinds[new][mine])
            known, all_logs = np.concatenate([self.known, kinds[new]]), np.concatenate([self.logs, logs])
            order = np.argsort(known, kind="stable")
            self.known, self.logs = known[order], all_logs[order]
        at = np.searchsorted(self.known, kinds)
        total = np.append(0.0, np.cumsum(self.logs[at][back]))
        return total[off[1:]] - total[off[:-1]]


def shards(model: DataFrame, order: int = ORDER, most: int = SHARD):
    """Shards one by one; the driver holds one at a time."""
    small = model.filter("pair is null").select("kind", "key", "value").toArrow()  # 2 * 256**2 rows at most
    sizes = model.filter("pair is not null").groupBy("pair").count().orderBy("pair").toArrow()  # 256**2 rows at most
    pair, count = sizes["pair"].to_numpy(), sizes["count"].to_numpy()
    every = np.arange(_PAIRS)
    lo, at = 0, 0
    while True:
        size, end = 0, at
        while end < len(pair) and (end == at or size + count[end] <= most):
            size += count[end]
            end += 1
        hi = _PAIRS if end == len(pair) else int(pair[end])
        rows = [small]
        if end > at:
            rows.append(model.filter(F.col("pair").between(lo, hi - 1)).select("kind", "key", "value").toArrow())
        kind, key, value = (np.concatenate([r[c].to_numpy() for r in rows]) for c in ("kind", "key", "value"))
        h = hashed(kind, key)
        place = np.argsort(h)
        yield Shard(h[place], value[place], (every >= lo) & (every < hi), order)
        lo, at = hi, end
        if at == len(pair):
            return


def with_log_probability(docs: DataFrame, text: str, name: str, order: int = ORDER, most: int = SHARD) -> DataFrame:
    """``docs`` with ``name``: the logarithm of the probability of the bytes of
    column ``text`` under a model of all its texts; 0 for null and empty."""
    model = entries(gram_counts(docs.select(F.col(text).alias("text")), order), order)
    context = docs.sparkSession.sparkContext

    def scorer(shared):
        def work(texts: pa.Array) -> pa.Array:
            return pa.array(np.concatenate([np.zeros(0), *(shared.value.sums(data, off) for _, data, off in slices(texts, TEXT))]))
        return F.arrow_udf(work, "double")

    out, before = docs.withColumn(name, F.lit(0.0)), []
    for k, shard in enumerate(shards(model, order, most)):
        if k:  # texts go along, so that no task holds two shards
            out = stored(out, "scored")
            discard(*before)
            before = [out]
        out = out.withColumn(name, F.col(name) + scorer(context.broadcast(shard))(F.col(text)))
    return out

"""Quality classifier: gradient-boosted trees over document statistics.

Statistics come from whole texts.  Trees are grown level by level on binned
statistics (histograms of gradients), all of one depth, and kept as flat
arrays: a row walks down by ``2 * node + 1 + (value > threshold)``.

Trees are fitted on at most TRAIN_ROWS labelled rows, chosen by a hash of
doc_id; labels, language, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored
from .grams import Words, slices

#: bound of the labelled rows a model is fitted on
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
STATISTICS = (
    "bytes", "words", "word_bytes", "longest_word", "upper", "lower", "digits", "spaces", "breaks", "non_ascii",
    "stops", "exclaims", "symbols", "brackets", "others", "repeats", "repeats_2", "distinct", "most_common",
    "line_bytes", "upper_words", "symbol_words", "distinct_bytes")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_UPPER, _LOWER, _DIGIT = (_class("".join(map(chr, range(a, b)))) for a, b in ((65, 91), (97, 123), (48, 58)))
_CLASSES = {"upper": _UPPER, "lower": _LOWER, "digits": _DIGIT, "spaces": _class(" "), "breaks": _class("\n"),
            "non_ascii": np.arange(256) > 127, "stops": _class(".,"), "exclaims": _class("!?"),
            "symbols": _class("#$%&*@^~+=|"), "brackets": _class("<>{}[]()/\\")}
_OTHER = ~np.any(list(_CLASSES.values()), axis=0)


def statistics(texts: pa.Array) -> np.ndarray:
    """Rows of STATISTICS for an Arrow column of texts; null counts as empty,
    and an empty text has zeros."""
    parts = [np.zeros((0, len(STATISTICS)))]
    for _, data, off in slices(texts):
        n = np.diff(off)
        size = np.maximum(n, 1)
        words = Words(data, off)
        per = np.diff(words.upto)
        some = np.maximum(per, 1)

        def share(mask, off=off):
            return np.diff(np.append(0, np.cumsum(mask))[off])

        def of_words(value, words=words):
            return np.diff(np.append(0, np.cumsum(value))[words.upto])

        col = dict.fromkeys(STATISTICS)
        col["bytes"], col["words"] = np.log1p(n), np.log1p(per)
        for name, chars in (*_CLASSES.items(), ("others", _OTHER)):
            col[name] = share(chars[data]) / size
        length = words.end - words.start
        col["word_bytes"] = of_words(length) / some
        col["line_bytes"] = n / (share(data == 10) + 1)
        col["upper_words"] = of_words(_UPPER[data[words.start]] & _UPPER[data[words.end - 1]] & (length > 1)) / some \
            if len(length) else np.zeros(len(n))
        col["symbol_words"] = of_words(_CLASSES["symbols"][data[words.end - 1]] | _CLASSES["exclaims"][data[words.end - 1]]) / some \
            if len(length) else np.zeros(len(n))
        h = words.hashes()
        for name, step in (("repeats", 1), ("repeats_2", 2)):
            same = np.zeros(len(h), bool)
            same[step:] = (h[step:] == h[:-step]) & (words.row[step:] == words.row[:-step])
            col[name] = of_words(same) / some
        order = np.lexsort((h, words.row))
        hs, rs = h[order], words.row[order]
        fresh = np.append(True, (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1]))[:len(hs)]
        col["distinct"] = np.bincount(rs[fresh], minlength=len(n)) / some
        starts = np.flatnonzero(fresh)
        runs = np.diff(np.append(starts, len(hs)))
        most = np.zeros(len(n))
        np.maximum.at(most, rs[starts], runs)
        col["most_common"] = most / some
        longest = np.zeros(len(n))
        np.maximum.at(longest, words.row, length)
        col["longest_word"] = np.log1p(longest)
        kinds = np.zeros((len(n), 256), bool)
        kinds[np.repeat(np.arange(len(n)), n), data] = True
        col["distinct_bytes"] = kinds.sum(axis=1)
        parts.append(np.column_stack([col[s] for s in STATISTICS]).astype(float))
    out = np.concatenate(parts)
    give_back()
    return out


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold`` per inner node, ``leaf`` per leaf; tree by tree."""
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
        least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1.  Without rows, or with one label
    only, every score is the share of ones (a half without rows)."""
    inner = 2 ** depth - 1
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    m = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    cell = binned + np.arange(m) * bins
    f = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        grad, hess = q - y, q * (1 - q)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        cut = np.full(inner, bins)
        node = np.zeros(len(y), int)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            place = ((node - first) * (m * bins))[:, None] + cell
            shape = (count, m, bins)
            g = np.bincount(place.ravel(), np.repeat(grad, m), count * m * bins).reshape(shape)
            h = np.bincount(place.ravel(), np.repeat(hess, m), count * m * bins).reshape(shape)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], threshold[first + k], cut[first + k] = j, edges[j][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf_of = node - inner
        g, h = (np.bincount(leaf_of, v, inner + 1) for v in (grad, hess))
        leaf = -rate * g / (h + ridge)
        f += leaf[leaf_of]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows no label of which is learned from; null doc_ids too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents outside the held-out fold.

    Of a doc_id with several labels the mean decides; null labels and ids are
    left out.  Statistics are computed by tasks; ``rows`` rows of numbers
    reach the driver.
    """
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col(target).alias("_y")).dropna().filter(~held_out(F.col("_id"))) \
        .groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y")) \
        .orderBy(F.xxhash64(F.lit(17), "_id"), "_id").limit(rows)
    stats = F.arrow_udf(lambda t: pa.array(list(statistics(t)), pa.list_(pa.float64())), "array<double>")
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # of repeated rows of a doc_id the largest text counts
    picked = stored(picked.select("doc_id", "_y", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"),
                                  stats("text").alias("x")), "stats")
    got = picked.groupBy("doc_id").agg(F.max_by(F.struct("_y", "x"), "_t").alias("r")).select("doc_id", "r.*") \
        .orderBy("doc_id").limit(rows).toArrow()
    if not len(got):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return fit(np.array(got["x"].to_pylist()), got["_y"].to_numpy().astype(float))


def scores(text: Column, model: Trees) -> Column:
    """Score of a text, 0 to 1; a null or empty text has one too."""
    return F.arrow_udf(lambda t: pa.array(model.score(statistics(t)), pa.float64()), "double")(text)


def with_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` with held_out, score and predicted (columns of these names are
    replaced; others stay as they are).

    Every row has a score, null and empty texts and null doc_ids too, which
    count as held out.  Rows that repeat, or share a doc_id with different
    texts, are scored each by their own text; in training the mean label of a
    doc_id counts once.  Texts of any length are read whole.  Without labels,
    or with one kind only, every score is their share of ones.  An empty table
    gives no rows."""
    model = train(docs, labels, **options)
    out = docs.drop("held_out", "score", "predicted")
    return out.withColumn("held_out", held_out(out["doc_id"])).withColumn("score", scores(out["text"], model)) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))

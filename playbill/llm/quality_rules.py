"""Quality rules: base rules of a text, and bands of n-gram perplexity.

Base rules look at one text.  Every text is then scored by a modified
Kneser-Ney model counted over all texts (``ngram_model``).  A language has a
middle, the median of nats per byte of its texts that pass the base rules, and
a spread, their median distance from it, both as of texts of one length; texts
beyond an upper or a lower band round the middle are rejected.  Medians are read off histograms, so no task or
driver sees more than one row per step of the scale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, stored
from .grams import slices
from .ngram_model import ORDER, SHARD, TEXT, with_log_probability

LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: steps of the scale per nat
STEPS = 4096
#: widths of the bands, in spreads
LOWER, UPPER = 5.0, 4.0
#: bytes from which a longer text is not held to a narrower band
FULL = 4096
#: smallest spread, in steps: a language of equal texts has no spread of its own
LEAST_SPREAD = 20
#: texts of a language that the spread of all languages counts for
PRIOR = 30
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(ids: np.ndarray, row: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window that their row has twice or more.

    ``ids`` numbers the words.  Windows are named exactly: pairs of names of
    one length give those of a longer one, and only what its row has twice at
    one length is looked at again at the next."""
    n = len(ids)
    hit = np.zeros(n + 1, np.int64)
    if n < window:
        return hit[:n] > 0
    at, name, size = np.arange(n), row * np.int64(int(ids.max()) + 1) + ids, 1
    while True:
        kinds, back, times = np.unique(name, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        at, name = at[twice], back[twice]
        if size == window:
            break
        step = min(size, window - size)
        full = np.full(n + step, -1)
        full[at] = name
        ahead = full[at + step]
        ok = ahead >= 0
        ok[ok] = row[at[ok]] == row[at[ok] + step]
        at, name, size = at[ok], name[ok] * np.int64(len(kinds)) + ahead[ok], size + step
    hit[at] += 1
    np.subtract.at(hit, at + window, 1)
    return np.cumsum(hit)[:n] > 0


def base_counts(texts: pa.Array) -> pa.Array:
    """The counts of the base rules; null counts as empty."""
    cols = [[] for _ in _BASE]
    for _, data, off in slices(texts, TEXT):
        raw, cuts = data.tobytes(), off.tolist()
        upto = lambda mask, off=off: np.diff(np.append(0, np.cumsum(mask))[off])
        number: dict[bytes, int] = {}
        ids, sizes, lines = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            words = raw[a:b].split()  # bytes: ASCII white space only
            ids += [number.setdefault(w, len(number)) for w in words]
            sizes.append(len(words))
            full = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
            lines.append(len(full) - len(set(full)))
        row = np.repeat(np.arange(len(sizes)), sizes)
        again = repeated_words(np.array(ids, np.int64), row)
        chars = (data & 0xC0) != 0x80
        for col, v in zip(cols, (sizes, upto(chars & ~_SPACE[data]), upto(_SYMBOL[data]), lines,
                                 np.bincount(row[again], minlength=len(sizes))), strict=True):
            col.append(np.asarray(v, np.int64))
    return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in cols], list(_BASE))


def failed(least: int = LEAST_WORDS, most: int = MOST_REPEATED) -> Column:
    return (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > most * F.col("n_words"))


def median(rows: DataFrame, by: str, value: str, times: Column | None = None) -> DataFrame:
    """(by, n, median): the lower median of an integer per group, from counts
    of its values; a row counts ``times``."""
    w = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.groupBy(by, value).agg(F.sum(F.lit(1) if times is None else times).alias("c")).withColumns(
        {"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(by))})
    return upto.filter(2 * F.col("upto") >= F.col("n")).groupBy(by).agg(F.min(value).alias("median"), F.max("n").alias("n"))


def _off_middle() -> Column:
    """Distance from the middle in steps, as of a text of FULL bytes: that of
    a shorter text varies with the root of its length."""
    return F.floor((F.col("step") - F.col("m")) * F.sqrt(F.least(F.col("bytes"), F.lit(FULL)) / F.lit(FULL)))


def bands(rows: DataFrame) -> DataFrame:
    """(l, m, spread): middle and spread of each language in steps, from rows
    (lang, step, bytes).  The spread of all languages counts as PRIOR texts of
    each, so that one of few texts has a spread to go by."""
    middle = stored(median(rows, "lang", "step").select(F.col("lang").alias("l"), F.col("median").alias("m")), "middle")
    gaps = rows.join(middle, F.col("lang").eqNullSafe(F.col("l"))).select("lang", F.lit(0).alias("all"), F.abs(_off_middle()).alias("gap"))
    gaps = stored(gaps.groupBy("lang", "all", "gap").count(), "gaps")
    every = median(gaps, "all", "gap", F.col("count")).first()
    every = max(every["median"], LEAST_SPREAD) if every else LEAST_SPREAD
    gap = median(gaps, "lang", "gap", F.col("count")).select(
        F.col("lang").alias("g"), ((F.col("n") * F.col("median") + PRIOR * every) / (F.col("n") + PRIOR)).alias("spread"))
    return stored(middle.join(gap, F.col("l").eqNullSafe(F.col("g"))).select("l", "m", F.greatest("spread", F.lit(float(LEAST_SPREAD))).alias("spread")), "bands")


def rules(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, order: int = ORDER, shard: int = SHARD) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, perplexity (per byte) and kept.

    * Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null or empty text
      has none, fails the base rules and has a perplexity of null.
    * Bands are those of the row's language; null is a language of its own.
      Texts that fail the base rules count in the model, not in the bands.
    * Repeated rows and null doc_ids are rows like others.  Very long texts
      are read whole.  An empty table gives no rows.
    * The caller's columns travel as one struct, so none clashes; columns with
      the names of results are replaced.
    """
    new = (*_BASE, "base_failed", "perplexity", "kept")
    rows = docs.select(boxed(docs, *new), F.col("text"), F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"))
    scored = with_log_probability(rows, "text", "log", order, shard)
    kind = ", ".join(f"{c} long" for c in _BASE)
    scored = scored.select("row", "lang", "log", F.octet_length("text").alias("bytes"), F.arrow_udf(base_counts, kind)("text").alias("b"))
    scored = stored(scored.select("row", "lang", "log", "bytes", "b.*"), "rules")
    nats = F.when(F.col("bytes") > 0, -F.col("log") / F.col("bytes"))
    scored = scored.withColumns({"base_failed": failed(), "step": F.floor(nats * STEPS), "perplexity": F.exp(nats)})
    limits = bands(scored.filter(~F.col("base_failed") & F.col("step").isNotNull()).select("lang", "step", "bytes"))
    inside = F.coalesce(_off_middle().between(-lower * F.col("spread"), upper * F.col("spread")), F.lit(False))
    return scored.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left") \
        .withColumn("kept", ~F.col("base_failed") & inside).select("row.*", *new)

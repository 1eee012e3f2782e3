"""Ranked lexical search by presence masks.

1. Queries are taken in passes of at most ITEMS; their distinct terms are the
   vocabulary of a pass.
2. One pass over the documents counts terms.  Words are looked up in the
   vocabulary by hash and confirmed by their bytes.  What is kept of a block of
   documents is their lengths and their postings for the vocabulary.
3. Per block every vocabulary term has a bitmap of the documents that hold it.
   The bitmaps of an item's terms, one bit each, make a mask per document, and
   documents are grouped by mask.  A mask has a maximum score: the best
   contribution of each of its terms in the block.  Masks are evaluated by
   descending maximum, and when the next is below the score of the k-th best
   document so far, no further document can get in.
4. Each task yields its k best documents per item; they are ranked in two steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import numbered, stored
from .grams import LOWER, Words, slices

#: items one pass over the documents serves
ITEMS = 2000
#: bytes of a block's bitmaps, which bounds its documents
BITMAPS = 1 << 26
#: bytes of text counted at a time
TEXT = 1 << 21
TOP = 10
#: ASCII characters between terms
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def term_words(data: np.ndarray, off: np.ndarray) -> Words:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, with
    A-Z in lower case."""
    return Words(LOWER[data], off, breaks=_BREAK)


class Vocabulary:
    """Numbered distinct terms, found by hash and confirmed by bytes."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.flat = np.frombuffer(b"".join(terms), np.uint8)
        size = np.array([len(t) for t in terms], np.int64)
        self.off = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        # one row of text, a word per term
        for self.lane in (0, 1):
            h = Words.of_ranges(self.flat, self.off[:-1], self.off[1:]).hashes(self.lane)
            order = np.argsort(h, kind="stable")
            self.hash, self.number = h[order], order
            if (self.hash[1:] != self.hash[:-1]).all():
                return
        raise ValueError("two terms with equal hashes in both lanes")

    def find(self, words: Words) -> np.ndarray:
        """Number of every word, or -1."""
        out = np.full(len(words.start), -1)
        if not len(self.terms) or not len(out):
            return out
        h = words.hashes(self.lane)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        number, size = self.number[at], words.end - words.start
        hit = np.flatnonzero((self.hash[at] == h) & (size == np.diff(self.off)[number]))
        if not len(hit):
            return out
        size, number = size[hit], number[hit]
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        same = words.data[np.repeat(words.start[hit], size) + step] == self.flat[np.repeat(self.off[number], size) + step]
        good = np.logical_and.reduceat(same, first)
        out[hit[good]] = number[good]
        return out


@dataclass
class Queries:
    """Items of one pass: distinct terms (numbers, ascending) and how often
    each occurs."""
    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    words: Vocabulary


def read_items(ids: pa.Array, texts: pa.Array) -> Queries:
    numbers: dict[bytes, int] = {}
    terms, times = [], []
    for _, data, off in slices(texts):
        words = term_words(data, off)
        raw = words.data.tobytes()
        found = [numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
        for a, b in zip(words.upto[:-1].tolist(), words.upto[1:].tolist(), strict=True):
            t, n = np.unique(np.array(found[a:b], np.int64), return_counts=True)
            terms.append(t)
            times.append(n)
    return Queries(ids.to_pylist(), terms, times, Vocabulary(list(numbers)))


def _lists(cuts: np.ndarray, flat: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)


def postings(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Stored blocks of documents that hold a vocabulary term: ids, lengths,
    postings by document (cuts, terms, tf); and what the block adds to the
    number of documents, of terms, and of documents per term."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), *(
        T.StructField(n, T.ArrayType(T.LongType())) for n in ("n", "cuts", "terms", "tf", "seen", "seen_docs")),
        T.StructField("docs", T.LongType()), T.StructField("length", T.LongType())])

    def work(batches):
        for batch in batches:
            for at, data, off in slices(batch["text"], TEXT):
                found = term_words(data, off)
                n = np.diff(found.upto)
                number = words.find(found)
                hit = number >= 0
                pair, tf = np.unique(found.row[hit] * np.int64(max(len(words.terms), 1)) + number[hit], return_counts=True)
                row, term = np.divmod(pair, max(len(words.terms), 1))
                held, first = np.unique(row, return_index=True)
                seen, seen_docs = np.unique(term, return_counts=True)
                lists = [batch["doc_id"].slice(at, len(n)).take(pa.array(held)),
                         *(pa.array(x, pa.int64()) for x in (n[held], np.append(first, len(row)), term, tf, seen, seen_docs))]
                yield pa.RecordBatch.from_arrays(
                    [_lists([0, len(x)], x) for x in lists] + [pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])],
                    schema.fieldNames())

    return stored(docs.select("doc_id", "text").mapInArrow(work, schema), "postings")


class Best:
    """The best documents of an item so far, in order of rank."""

    def __init__(self, top: int):
        self.top, self.score, self.doc, self.null = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """The score below which no document gets in."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        fit = score >= max(self.least(), 1)
        score, doc, null = (np.concatenate(x) for x in
                            ((self.score, score[fit]), (self.doc, doc[fit]), (self.null, null[fit])))
        order = np.lexsort((doc, null, -score))[:self.top]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class Block:
    """Documents with their postings and the bitmaps of all terms."""

    def __init__(self, doc, null, size, cuts, terms, gain, n_terms):
        self.doc, self.null, self.cuts, self.terms, self.gain = doc, null, cuts, terms, gain
        self.present = np.zeros((n_terms, len(doc)), bool)
        self.present[terms, np.repeat(np.arange(len(doc)), np.diff(cuts))] = True
        #: best contribution of each term in the block
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, terms, gain)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct masks as rows of bits, and the mask of every document."""
        keys = []
        for a in range(0, len(terms), 64):
            key = np.zeros(len(self.doc), np.uint64)
            for j, t in enumerate(terms[a:a + 64].tolist()):
                key |= self.present[t].astype(np.uint64) << np.uint64(j)
            keys.append(key)
        kinds, group = np.unique(keys[0], return_inverse=True)
        kinds = kinds[:, None]
        for key in keys[1:]:
            more, other = np.unique(key, return_inverse=True)
            pair, group = np.unique(group * np.int64(len(more)) + other, return_inverse=True)
            kinds = np.column_stack([kinds[pair // len(more)], more[pair % len(more)]])
        j = np.arange(len(terms))
        return (kinds[:, j // 64] >> (j % 64).astype(np.uint64)) & np.uint64(1) == 1, group

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        size = self.cuts[rows + 1] - self.cuts[rows]
        first = np.cumsum(size) - size
        at = np.repeat(self.cuts[rows] - first, size) + np.arange(size.sum())
        return np.add.reduceat(weight[self.terms[at]] * self.gain[at], first)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        if not len(terms) or not len(self.doc):
            return
        bits, group = self.masks(terms)
        limit = bits @ (times * self.most[terms])
        order = np.argsort(-limit, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        limit = limit[order]
        by = np.argsort(place[group], kind="stable")  # documents by descending maximum of their mask
        upto = np.cumsum(np.bincount(place[group], minlength=len(order)))
        weight = np.zeros(len(self.present), np.int64)
        weight[terms] = times
        mask, done, chunk = 0, 0, 4 * best.top
        while mask < len(order) and limit[mask] >= best.least():
            mask = min(int(np.searchsorted(upto, done + chunk)) + 1, len(order))
            rows = by[done:upto[mask - 1]]
            best.add(self.scores(rows, weight), self.doc[rows], self.null[rows])
            done, chunk = int(upto[mask - 1]), 2 * chunk


def _blocks(batches, n_terms: int):
    """Stored blocks joined until their bitmaps are full."""
    most = max(256, BITMAPS // max(n_terms, 1))
    parts, rows = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            # zero copy: list columns of one row
            one = {c: batch[c][k].values for c in ("ids", "n", "cuts", "terms", "tf")}
            parts.append(one)
            rows += len(one["ids"])
            if rows >= most:
                yield parts
                parts, rows = [], 0
    if rows:
        yield parts


def tops(blocks: DataFrame, asked: Queries, weights: np.ndarray, docs: int, length: int, top: int, item_type: T.DataType) -> DataFrame:
    """(no, item_id, doc_id, score): the best documents of each task."""
    ids, terms, times = asked.ids, asked.terms, asked.times
    doc_type = blocks.schema["ids"].dataType.elementType
    item_arrow, doc_arrow = to_arrow_type(item_type), to_arrow_type(doc_type)

    def work(batches):
        best = [Best(top) for _ in ids]
        for parts in _blocks(batches, len(weights)):
            null = np.concatenate([np.asarray(p["ids"].is_null()) for p in parts])
            doc = np.concatenate([np.asarray(p["ids"].fill_null(0)) for p in parts]).astype(np.int64)
            n, term, tf = (np.concatenate([np.asarray(p[c]) for p in parts]) for c in ("n", "terms", "tf"))
            sizes = np.concatenate([np.diff(np.asarray(p["cuts"])) for p in parts])
            m = 25 + (75 * n * docs) // length
            gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))
            block = Block(doc, null, n, np.append(0, np.cumsum(sizes)), term, gain, len(weights))
            for item in range(len(ids)):
                block.search(terms[item], times[item], best[item])
        for at in range(0, len(ids), 512):
            some = range(at, min(at + 512, len(ids)))
            size = [len(best[i].score) for i in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(some), size)), pa.array([ids[i] for i, n in zip(some, size, strict=True) for _ in range(n)], item_arrow),
                 pa.array(np.concatenate([best[i].doc for i in some]), mask=np.concatenate([best[i].null for i in some])).cast(doc_arrow),
                 pa.array(np.concatenate([best[i].score for i in some]))], ["no", "item_id", "doc_id", "score"])

    return blocks.select("ids", "n", "cuts", "terms", "tf").mapInArrow(work, T.StructType([
        T.StructField("no", T.LongType()), T.StructField("item_id", item_type),
        T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())]))


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each ``no``; ranked within 64 shares of an item
    first, so that no task reads what all tasks found for it."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    share = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    some = found.withColumn("share", share).withColumn(
        "r", F.row_number().over(Window.partitionBy("no", "share").orderBy(*order))).filter(F.col("r") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, per_pass: int = ITEMS) -> DataFrame:
    """The ``top`` documents of every item: item_id, rank, doc_id, score.

    Score and statistics are integers, as the contract fixes them: the
    statistics count whole texts of all documents.

    * Every row of ``items`` is an item of its own, also one whose id repeats
      or is null; an item without text or terms finds nothing.
    * Every row of ``docs`` is a document of its own.  Null and empty texts
      have no terms.  At equal scores null doc_ids come last.
    * A text of any length is read whole.  Empty tables give no rows.
    * Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    item_type = items.schema["item_id"].dataType
    items = numbered(items.select("item_id", "text"), F.col("item_id").asc_nulls_last(), F.col("text").asc_nulls_last(), tag="items", name="no")
    out = []
    for at in range(0, items.count(), per_pass):
        rows = items.filter(F.col("no").between(at, at + per_pass - 1)).orderBy("no").select("item_id", "text").toArrow()
        asked = read_items(rows["item_id"].combine_chunks(), rows["text"].combine_chunks())
        blocks = postings(docs, asked.words)
        n, length = blocks.agg(F.sum("docs"), F.sum("length")).first()
        if not n:
            continue
        df = blocks.select(F.explode(F.arrays_zip("seen", "seen_docs")).alias("s")).groupBy(F.col("s.seen").alias("term")) \
            .agg(F.sum("s.seen_docs").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1)))
        found = df.select("term", weight.cast("long").alias("w")).toArrow()
        weights = np.zeros(len(asked.words.terms), np.int64)
        weights[found["term"].to_numpy()] = found["w"].to_numpy()
        out.append(stored(ranked(tops(blocks, asked, weights, n, length, top, item_type), top).select("item_id", "rank", "doc_id", "score"), "tops"))
    if not out:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
                                                       T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())]))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result

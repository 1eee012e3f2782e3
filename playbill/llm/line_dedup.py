"""Line dedup with two Bloom filters.

Each task keeps a filter of line hashes it has seen once and one of those seen
twice, in different documents.  Filters of tasks are merged slice by slice:
what is in two once-filters has been seen twice.  Lines outside the merged
twice-filter are certainly unique and never move.  Only suspected repeats are
shuffled; they are confirmed by their text, and the smallest doc_id that holds
a line keeps it.

The filter is the only broadcast.  Its size follows the number of lines up to
MAX_BITS; beyond that more lines are suspected, and results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, stored

MIN_CHARS = 10
BITS_PER_LINE = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
PROBES = 4
SLICE_BYTES = 1 << 13
STRIP = b" \t\n\r\x0b\x0c"
#: stands for a null doc_id, which comes after all others
LAST = (1 << 63) - 1


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()  # of bytes: A-Z only


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def keys_of(text: str | None, least: int) -> set[bytes]:
    found = {line_key(x) for x in (text or "").encode().split(b"\n")}
    return {k for k in found if long_enough(k, least)}


def _hash(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and mask of each probe of each hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    at = (hashes[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)
    return (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8)


def contains(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at, mask = probes(hashes, bits)
    return ((filter_[at] & mask) != 0).all(axis=1)


def add(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    at, mask = probes(hashes, bits)
    np.bitwise_or.at(filter_, at.ravel(), mask.ravel())


def filter_bits(lines: int, most: int = MAX_BITS) -> int:
    return min(most, max(MIN_BITS, 1 << (BITS_PER_LINE * max(lines, 1) - 1).bit_length()))


def twice_filter(docs: DataFrame, bits: int, least: int) -> np.ndarray:
    """The merged filter of lines seen in two documents or more."""
    def seen(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            per_doc = [_hash(keys_of(t, least)) for t in batch.column("text").to_pylist()]
            found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *per_doc]), return_counts=True)
            add(twice, found[(times > 1) | contains(once, found, bits)], bits)
            add(once, found, bits)
        parts = once.reshape(-1, min(SLICE_BYTES, bits // 8)), twice.reshape(-1, min(SLICE_BYTES, bits // 8))
        some = np.flatnonzero(parts[0].any(axis=1))
        for at in range(0, len(some), 256):
            k = some[at:at + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int64()), *(pa.array([p[i].tobytes() for i in k], pa.binary()) for p in parts)],
                ["slice", "once", "twice"])

    def merge(batches):
        now, once, twice = None, None, None
        for batch in batches:
            out = []
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in ("slice", "once", "twice")), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if k != now:
                    if now is not None and twice.any():
                        out.append((now, twice.tobytes()))
                    now, once, twice = k, a, b
                else:
                    once, twice = once | a, twice | b | (once & a)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()),
                                                  pa.array([v for _, v in out], pa.binary())], ["slice", "twice"])
        if now is not None and twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([twice.tobytes()], pa.binary())],
                                             ["slice", "twice"])

    parts = docs.select("text").mapInArrow(seen, "slice long, once binary, twice binary")
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice long, twice binary")
    out = np.zeros((bits // 8 // min(SLICE_BYTES, bits // 8), min(SLICE_BYTES, bits // 8)), np.uint8)
    table = merged.toArrow()
    for k, v in zip(table["slice"].to_pylist(), table["twice"].to_pylist(), strict=True):
        out[k] = np.frombuffer(v, np.uint8)
    return out.ravel()


def repeated_lines(docs: DataFrame, least: int = MIN_CHARS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, keys): the lines each document loses, as normalised keys."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0]
    bits = filter_bits(lines or 0, max_bits)
    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, bits, least).tobytes())

    def suspects(batches):
        twice = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = list(keys_of(text, least))
                if own:
                    hit = contains(twice, _hash(own), bits).tolist()
                    mine = [k for k, h in zip(own, hit, strict=True) if h]
                    ids += [doc] * len(mine)
                    keys += mine
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["id", "key"])

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    found = stored(docs.select(ids.alias("id"), "text").mapInArrow(suspects, "id long, key binary"), "suspects")
    first = found.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    first = stored(first.select("key", "first"), "repeated")  # on its own, so that a join on a hot line can be split
    lost = found.join(first, "key").filter("id > first")
    return lost.groupBy("id").agg(F.collect_set("key").alias("keys"))


def _kept(text: pa.Array, keys: pa.Array) -> pa.Array:
    texts, counts, dropped = [], [], []
    for t, gone in zip(text.to_pylist(), keys.to_pylist(), strict=True):
        lines = (t or "").encode().split(b"\n")
        gone = set(gone or ())
        left = [x for x in lines if line_key(x) not in gone] if gone else lines
        texts.append(b"\n".join(left).decode())
        counts.append(len(lines))
        dropped.append(len(lines) - len(left))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                                       pa.array(dropped, pa.int64())], ["kept_text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, least: int = MIN_CHARS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z in
    lower case.  Keys of at least ``least`` code points in two or more
    documents stay in the smallest doc_id only (there all their lines stay);
    a null doc_id comes last.  Repeated rows of one doc_id are one document.
    A null or empty text is one empty line; a text of any length is split
    whole.  An empty table gives no rows.  Columns of ``docs`` with the names
    of results are replaced; others travel as one struct, so none clashes.
    """
    new = ("kept_text", "n_lines", "n_dropped")
    lost = repeated_lines(docs.select("doc_id", "text"), least, max_bits)
    base = docs.select(boxed(docs, *new), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"))
    out = F.arrow_udf(_kept, "kept_text string, n_lines long, n_dropped long")(F.col("row.text"), F.col("keys"))
    return base.join(lost, "id", "left").select("row", out.alias("new")).select("row.*", "new.*")

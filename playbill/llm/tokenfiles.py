"""Token-ID files of patched frame-of-reference blocks.

A segment is one binary value, readable on its own::

    magic 'PFR1' | n_docs | n_blocks | n_ids          (uint32 each)
    ids per document                                  uint32[n_docs]
    byte offset of every block in the block area      uint32[n_blocks]
    blocks

and a block of up to BLOCK ids is::

    minimum uint32 | ids uint16 | width uint8 | 0 | exceptions uint32
    values less the minimum, ``width`` low bits each, packed
    exception places uint16[...], their high bits uint32[...]

The width is the one that holds PERCENTILE of the block's values; the others
keep their low bits in place and their high bits in the exception list.  Any
block can be read alone through the offsets.

Segments are rows of a Parquet table, so that Spark's committer handles lost
executors and any Hadoop file system holds them: ``file`` (range of doc_ids),
``segment`` (place in it), ``first`` (ids before it in the file), ``doc_ids``.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, shared_folder
from .tokens import encoder

BLOCK = 4096
PERCENTILE = 95
SEGMENT_IDS = 1 << 19
SCHEMA = "file long, segment long, first long, n_ids long, doc_ids array<long>, payload binary"
ROW = pa.schema([("file", pa.int64()), ("segment", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()),
                 ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
MAGIC = b"PFR1"


def _pack(values: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def _unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n * width].reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = ids.min()
    rest = ids - low
    at = -(-(len(rest) - 1) * percentile // 100)
    width = int(np.partition(rest, int(at))[int(at)]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, int)
    head = np.array([low], np.uint32).tobytes() + np.array([len(ids)], np.uint16).tobytes() + bytes([width, 0])
    return head + np.array([len(over)], np.uint32).tobytes() + _pack(rest, width) \
        + over.astype(np.uint16).tobytes() + (rest[over] >> np.uint32(width)).astype(np.uint32).tobytes()


def decode_block(raw: bytes) -> np.ndarray:
    low, = np.frombuffer(raw, np.uint32, 1)
    n, = np.frombuffer(raw, np.uint16, 1, 4)
    n, width = int(n), raw[6]
    m = int(np.frombuffer(raw, np.uint32, 1, 8)[0])
    at = 12 + (n * width + 7) // 8
    values = _unpack(raw[12:at], n, width)
    if m:
        where = np.frombuffer(raw, np.uint16, m, at)
        values[where] |= np.frombuffer(raw[at + 2 * m:at + 6 * m], np.uint32) << np.uint32(width)
    return values + low


def encode_segment(documents: list[np.ndarray], block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    blocks = [encode_block(ids[i:i + block], percentile) for i in range(0, len(ids), block)]
    sizes = np.array([len(b) for b in blocks], np.int64)
    head = np.array([len(documents), len(blocks), len(ids)], np.uint32).tobytes()
    return MAGIC + head + np.array([len(d) for d in documents], np.uint32).tobytes() \
        + (np.cumsum(sizes) - sizes).astype(np.uint32).tobytes() + b"".join(blocks)


def decode_segment(raw: bytes) -> list[np.ndarray]:
    if raw[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_blocks, n_ids = np.frombuffer(raw, np.uint32, 3, 4).tolist()
    sizes = np.frombuffer(raw, np.uint32, n_docs, 16)
    starts = np.frombuffer(raw, np.uint32, n_blocks, 16 + 4 * n_docs).tolist()
    area = 16 + 4 * (n_docs + n_blocks)
    ends = [*starts[1:], len(raw) - area][:n_blocks]
    ids = np.concatenate([np.zeros(0, np.uint32)] + [
        decode_block(raw[area + a:area + b]) for a, b in zip(starts, ends, strict=True)])
    assert len(ids) == n_ids
    return np.split(ids, np.cumsum(sizes)[:-1]) if n_docs else []


def read_block(raw: bytes, k: int) -> np.ndarray:
    """Block ``k`` of a segment, found through the block starts."""
    n_docs, n_blocks, _ = np.frombuffer(raw, np.uint32, 3, 4).tolist()
    starts = np.frombuffer(raw, np.uint32, n_blocks, 16 + 4 * n_docs).tolist()
    area = 16 + 4 * (n_docs + n_blocks)
    end = starts[k + 1] if k + 1 < n_blocks else len(raw) - area
    return decode_block(raw[area + starts[k]:area + end])


def write_tokens(docs: DataFrame, tokenizer: str, units: str, end_id: int, path: str,
                 block: int = BLOCK, percentile: float = PERCENTILE, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` and write them in ascending doc_id order (null first).

    Texts are range-sorted, then encoded and written by the task that holds
    them.  A segment ends at ``segment_ids``; a document stays in one segment.
    A null or empty text is the end id alone; repeated rows are written each;
    a text of any length is encoded whole.  An empty table gives files without
    documents.  Columns other than doc_id and text are not read.
    """
    end = np.uint32(end_id)

    def encode(batches):
        code = encoder(tokenizer, units)
        file, segment, first, held, names, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def row():
            return pa.RecordBatch.from_pylist([{
                "file": file, "segment": segment, "first": first, "n_ids": size, "doc_ids": names,
                "payload": encode_segment(held, block, percentile)}], ROW)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for k, ids in code.encode(batch.column("text")):
                held.append(np.append(ids, end))
                names.append(keys[k])
                size += len(held[-1])
                if size >= segment_ids:
                    yield row()
                    segment, first, held, names, size = segment + 1, first + size, [], [], 0
        if held:
            yield row()

    # the text decides ties, so reruns write the same files
    rows = docs.select("doc_id", "text").withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(encode, SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files at ``path``: doc_id, start (ids before it in all
    files), n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "file long, segment long, doc_id long, place long, n_tokens long, ids_crc32 long" \
        + (", ids array<long>" if with_ids else "")
    table = spark.read.schema(SCHEMA).parquet(path)

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = decode_segment(row["payload"])
                sizes = np.array([len(x) for x in found], np.int64)
                out = {"file": pa.array([row["file"]] * len(found), pa.int64()),
                       "segment": pa.array([row["segment"]] * len(found), pa.int64()),
                       "doc_id": pa.array(row["doc_ids"], pa.int64()),
                       "place": pa.array(row["first"] + np.cumsum(sizes) - sizes, pa.int64()),
                       "n_tokens": pa.array(sizes, pa.int64()),
                       "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([x.tolist() for x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    rows = table.select("file", "segment", "first", "doc_ids", "payload").mapInArrow(decode, schema)
    sums = table.groupBy(F.col("file").alias("part")).agg(F.sum("n_ids").alias("n"))
    before = offsets(sums, "n").withColumnRenamed("part", "file")
    return rows.join(before, "file").withColumn("start", F.col("before") + F.col("place")).select(
        "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_folder(spark) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"

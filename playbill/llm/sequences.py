"""Documents as token pieces, and pieces as packed sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored
from .packing import pack
from .tokens import MEMORY, drop_encoders, encoder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, units: str = "leading", end_id: int = 0,
           capacity: int = CAPACITY, with_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """Pieces of every document: its ids and ``end_id``, cut only if longer
    than ``capacity``.  A null or empty text is the end id alone.  With
    ``with_ids`` the ids come along as little-endian unsigned 32-bit bytes.
    A worker remembers the ids of about ``memory`` distinct words; fewer than
    usual cost time, not results, and are forgotten when a task ends."""
    end = np.array([end_id], np.uint32).tobytes()

    def encode(batches):
        code = encoder(tokenizer, units, memory)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            cols = [[] for _ in range(6)]
            for k, ids in code.encode(batch.column("text")):
                ids = ids.tobytes() + end
                for p, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + n)]
                    for col, v in zip(cols, (keys[k], p, start, n, zlib.crc32(part), part if with_ids else None), strict=True):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)][:keep], names[:keep])
        if memory < MEMORY:
            del code
            drop_encoders()
            give_back()

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES + (", ids binary" if with_ids else ""))


def packed_pieces(docs: DataFrame, tokenizer: str, units: str = "leading", end_id: int = 0,
                  capacity: int = CAPACITY, memory: int = MEMORY) -> DataFrame:
    """All pieces of ``docs`` with sequence_id and offset.

    Repeated rows are packed as often as they come; a null doc_id is a value
    like others; a null or empty text is the end id alone; a text of any length
    is encoded whole and cut; an empty table has no pieces.  Other columns are
    not read.
    """
    found = stored(pieces(docs, tokenizer, units, end_id, capacity, memory=memory), "pieces")
    return pack(found, capacity, ["doc_id", "piece", "ids_crc32"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str, units: str = "leading", end_id: int = 0,
              capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids, an array of
    at most ``capacity``.  Rows with the same doc_id and text share ids, so
    either's place serves."""
    found = stored(pieces(docs, tokenizer, units, end_id, capacity, with_ids=True), "pieces")
    places = pack(found.drop("ids"), capacity, ["doc_id", "piece", "ids_crc32"])
    key = ["piece", "start", "length", "ids_crc32"]
    ids = found.groupBy("doc_id", *key).agg(F.first("ids").alias("ids")).withColumnRenamed("doc_id", "_id")
    on = [places[k] == ids[k] for k in key] + [places["doc_id"].eqNullSafe(ids["_id"])]
    rows = places.join(ids, on).select("sequence_id", "offset", "ids").repartition("sequence_id") \
        .sortWithinPartitions("sequence_id", "offset")

    def join(batches):
        now, parts = None, []
        for pdf in batches:
            out = []
            for seq, ids in zip(pdf["sequence_id"].tolist(), pdf["ids"].tolist(), strict=True):
                if seq != now and parts:
                    out.append((now, np.frombuffer(b"".join(parts), np.uint32).astype(np.int64)))
                    parts = []
                now = seq
                parts.append(ids)
            yield pd.DataFrame(out, columns=["sequence_id", "ids"])
        if parts:
            yield pd.DataFrame([(now, np.frombuffer(b"".join(parts), np.uint32).astype(np.int64))],
                               columns=["sequence_id", "ids"])

    return rows.mapInPandas(join, "sequence_id long, ids array<long>")

"""Vector code compression: product codes by Lloyd rounds over cover trees.

Vectors are quantised to integers and cut into parts.  A task cuts its rows
into blocks and builds one cover tree per block and part (``cover_tree``); trees
are stored once.  A round walks every tree against the codebook of its part:
subtrees that the triangle inequality settles are taken as a whole, with their
count and sum from running sums, and only ambiguous nodes descend to exact
comparisons.  A task adds up its blocks before it sends at most one row per
entry; the driver sees sums of entries only, never vectors.

All sums are integers, so the result does not depend on blocks or tasks.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .cover_tree import CoverTree, build

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: rows of one block: its distances are one matrix while its trees are built
BLOCK = 2048
_FIELDS = tuple(CoverTree.__dataclass_fields__)


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def quantised(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of ``width`` usable components."""
    sizes = np.asarray(pa.compute.list_value_length(vectors))
    if (sizes != width).any():
        raise ValueError(f"vectors of {sorted(set(sizes.tolist()))[:5]} components; the first has {width}")
    flat = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), width)
    out = np.floor(scale * flat)
    if out.size and np.abs(out).max() >= 1 << 30:
        raise ValueError("components beyond the range of 64-bit squared distances")
    return out.astype(np.int64)


def _packed(trees: list[tuple[CoverTree, np.ndarray]]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{f}{p}": getattr(t, f) for p, (t, _) in enumerate(trees) for f in _FIELDS},
             **{f"place{p}": where for p, (_, where) in enumerate(trees)})
    return out.getvalue()


def _unpacked(raw: bytes, parts: int):
    with np.load(io.BytesIO(raw)) as z:
        for p in range(parts):
            yield CoverTree(*(z[f"{f}{p}"] for f in _FIELDS)), z[f"place{p}"]


def tree_blocks(rows: DataFrame, width: int, parts: int, scale: int, block: int = BLOCK) -> DataFrame:
    """Stored rows (ids, labels, trees): blocks of ``rows`` (id, label, v)."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
                           T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)),
                           T.StructField("trees", T.BinaryType())])

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = quantised(part["v"], width, scale)
                trees = [build(c) for c in np.split(x, parts, axis=1)]
                one = [pa.array([0, part.num_rows], pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(*one, part["id"]), pa.ListArray.from_arrays(*one, part["label"]),
                     pa.array([_packed(trees)], pa.binary())], ["ids", "labels", "trees"])

    return stored(rows.mapInArrow(work, schema), "trees")


def _entry_sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): what each task's points add to each entry."""
    parts, entries, width = books.shape

    def work(batches):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for raw in batch["trees"]:
                for p, (tree, _) in enumerate(_unpacked(raw.as_py(), parts)):
                    node, entry = tree.assign(books[p])
                    total, count = tree.running()
                    np.add.at(sums[p], entry, total[tree.end[node]] - total[tree.begin[node]])
                    np.add.at(n[p], entry, count[tree.end[node]] - count[tree.begin[node]])
        p, e = np.nonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(sums[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), lists], ["part", "entry", "n", "sums"])

    return blocks.select("trees").mapInArrow(work, "part long, entry long, n long, sums array<long>")


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round; entries nothing is assigned to stay."""
    cells = _entry_sums(blocks, books).select("part", "entry", "n", F.posexplode("sums").alias("i", "s")) \
        .groupBy("part", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
    p, e, i, s, n = (cells[c].to_numpy() for c in ("part", "entry", "i", "s", "n"))
    books = books.copy()
    books[p, e, i] = s // n
    return books


def coded(blocks: DataFrame, books: np.ndarray, kind: T.StructType) -> DataFrame:
    """(vec_id, label, code, error) of every row of ``blocks``."""
    parts = len(books)

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = (pa.array(batch[c].slice(k, 1).flatten()) for c in ("ids", "labels"))
                code, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, (tree, place) in enumerate(_unpacked(batch["trees"][k].as_py(), parts)):
                    best = tree.labels(books[p])
                    gap = tree.points - books[p][best]
                    code[:, p], error = best[place], error + (gap * gap).sum(1)[place]
                text = code.tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([text[j:j + step] for j in range(0, len(text), step)], pa.string()),
                     pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(work, kind)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Product codes of all usable vectors, and the codebooks (part, entry,
    component).

    The rows are (vec_id, label, code, error): two hex digits per part, and the
    squared distance to the code's entries in units of ``1 / scale``.

    * Rows whose vector is null, empty or holds null or non-finite components
      are dropped.  Null ids and labels are kept; null ids come last in the
      order that picks the first entries, equal ids in the order of vectors.
    * Repeated rows are rows of their own.  With fewer than ``entries`` usable
      rows the codebook is as short; an empty table gives no rows.
    * Vectors of different lengths, of a length that ``parts`` does not divide,
      or with components of 2**30 / scale and more raise an error.
    * Other columns are not read, so their names cannot clash.
    """
    if entries > 256:
        raise ValueError("codes have two hex digits a part")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(usable(F.col("v")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    width = len(first[0]) if len(first) else parts
    if width % parts:
        raise ValueError(f"{width} components in {parts} parts")
    books = np.stack(np.split(quantised(first, width, scale), parts, axis=1))
    blocks = tree_blocks(rows, width, parts, scale)
    for _ in range(rounds if len(first) else 0):
        books = lloyd_round(blocks, books)
    kind = T.StructType([T.StructField("vec_id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType),
                         T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return stored(coded(blocks, books, kind), "codes"), books


def with_label_errors(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """Codes with ``label_error``, the error summed over rows of the same label
    (nulls together), and the digest of all entries."""
    totals = stored(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "labels")
    return codes.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

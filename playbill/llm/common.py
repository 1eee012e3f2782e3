"""Helpers of the operators: tables in the shared folder, positions in a
global order, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the contracts, as a regular expression class
SPACE = r"\x20\x09-\x0D"
#: rows of the hidden row number that one partition may hold
PART_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.  Only a local
    session that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.getCheckpointDir() is not None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        import tempfile
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here,
    a lost executor costs nothing, and readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and let Spark drop
    the shuffle files of finished queries."""
    if not tables:
        return
    jvm = tables[0].sparkSession._jvm
    conf = tables[0].sparkSession._jsc.hadoopConfiguration()
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers of earlier
    stages stay alive and count towards their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def boxed(docs: DataFrame, *replaced: str) -> Column:
    """All columns of ``docs`` but those that results replace, as one struct:
    no name of the caller's can clash with one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in replaced]).alias("row")


def in_order(df: DataFrame, *keys, tag: str = "sorted") -> DataFrame:
    """``df`` range-sorted by ``keys`` and stored with ``part`` (number of the
    range) and ``idx`` (place in it): no task holds more than one range."""
    m = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(rows.withColumn("_m", m).select(
        "*", F.shiftright("_m", PART_BITS).alias("part"),
        F.col("_m").bitwiseAND((1 << PART_BITS) - 1).alias("idx")).drop("_m"), tag)


def offsets(sums: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of ``value`` in all earlier parts.  ``sums`` has one row per part
    (and ``by``), so its window is as small as the number of partitions."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "part", F.coalesce(F.sum(value).over(w), F.lit(0)).alias("before"))


def numbered(df: DataFrame, *keys, tag: str = "ranked", name: str = "rank") -> DataFrame:
    """``df`` with ``name``: its place from 0 in the order of ``keys``."""
    rows = in_order(df, *keys, tag=tag)
    before = offsets(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "n")
    return rows.join(before, "part").withColumn(name, F.col("before") + F.col("idx")) \
        .drop("part", "idx", "before")


def running_sums(df: DataFrame, group: str, keys: list[str], value: str, tag: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the same
    ``group`` (an integer, never null) that come earlier in the order of
    ``keys``.

    Rows are range-sorted by (group, keys), so a group with a third of all
    rows spans many tasks.  Each task sums its range in one sweep; the sums of
    ranges, one row per task and group, are joined back.
    """
    def sweep(batches):
        part = TaskContext.get().partitionId()
        last, total = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            g = pdf[group].to_numpy()
            v = pdf[value].to_numpy().astype(np.int64)
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            lengths = np.diff(np.append(starts, len(g)))
            run = np.cumsum(v) - v
            run -= np.repeat(run[starts], lengths)
            if last == g[0]:
                run[:lengths[0]] += total
            last, total = g[-1], int(run[-1] + v[-1])
            yield pdf.assign(part=part, sofar=run)

    schema = T.StructType([*df.schema.fields, T.StructField("part", T.LongType()),
                           T.StructField("sofar", T.LongType())])
    rows = df.repartitionByRange(group, *keys).sortWithinPartitions(group, *keys)
    rows = stored(rows.mapInPandas(sweep, schema), tag)
    sums = rows.groupBy(group, "part").agg(F.sum(value).alias("n"))
    return rows.join(offsets(sums, "n", (group,)), [group, "part"]) \
        .withColumn("before", F.col("before") + F.col("sofar")).drop("part", "sofar")


def connected(edges: DataFrame, tag: str = "edges", rounds: int = 60) -> DataFrame:
    """Components of ``edges`` (long columns a, b): one row (node, root) for
    each node of an edge, root being the smallest id of its component.

    Alternates large-star and small-star: every round is two combinable
    aggregates and two joins on the node, and the edge set never grows.
    """
    spark = edges.sparkSession
    now = stored(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = stored(small, tag)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(roots)

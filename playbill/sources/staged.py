"""The staged event table on disk: append-only runs, bucketed by id.

A merge writes the rows it touched as one run,

    <root>/buckets=<B>/level=<L>/run=<first>_<last>/bucket=<b>/

whose rows carry the ``version`` (batch) that wrote them; the current state of
an id is its row with the highest version.  A batch reads only the buckets its
ids fall in, and files keep a Bloom filter of their ids.  A batch that is
replayed reads only versions before its own and overwrites its own run, so a
retry leaves the same table.

Runs are compacted level by level: FANOUT runs of one level become one run of
the next, so a row is rewritten once per level and a read meets few runs.  Only
versions that can no longer be replayed are compacted, and the runs a
compaction replaces are removed by the next one, after their readers ended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playbill.operators.merge import empty_stage
from playbill.schema import STAGED_SCHEMA, conform

BUCKETS, FANOUT = 64, 8
_FIELDS = [f.name for f in STAGED_SCHEMA.fields]
_STORED = T.StructType([*STAGED_SCHEMA.fields, T.StructField("version", T.LongType())])


def bucket_of(ident: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(buckets)).cast("int")


def touched_buckets(idents: DataFrame, ident: str = "id", buckets: int = BUCKETS) -> list[int]:
    """Buckets of a batch's ids: at most ``buckets`` numbers."""
    return sorted(r[0] for r in idents.select(bucket_of(F.col(ident), buckets)).distinct().collect())


def read_versions(spark: SparkSession, root: str, before: int | None = None,
                  touched: Sequence[int] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Every stored row with its ``version``; columns a later schema added are
    null in older runs.  With ``touched`` only those buckets are read."""
    try:
        rows = spark.read.schema(_STORED).parquet(root)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        rows = None
    if rows is None or "bucket" not in rows.columns:
        return empty_stage(spark).withColumn("version", F.lit(0).cast("long"))
    if touched is not None:
        rows = rows.filter((F.col("buckets") != buckets) | F.col("bucket").isin(*touched))
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    return rows.select("version", *_FIELDS)


def _latest(rows: DataFrame) -> DataFrame:
    """The newest row per id.  Versions collapse inside every map task first."""
    fields = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*fields), "version").alias("_r")).select("id", "_r.*")


def current(spark: SparkSession, root: str, before: int | None = None,
            touched: Sequence[int] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Latest row per id, of all ids or of the buckets a batch touches."""
    return _latest(read_versions(spark, root, before, touched, buckets)).select(*_FIELDS)


def _write_run(rows: DataFrame, root: str, level: int, first: int, last: int, buckets: int,
               order: Sequence[str] = ("id",)) -> str:
    path = f"{root}/buckets={buckets}/level={level}/run={first}_{last}"
    placed = rows.select(*_FIELDS, "version", bucket_of(F.col("id"), buckets).alias("bucket"))
    placed.repartition("bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite") \
        .option("parquet.bloom.filter.enabled#id", "true").partitionBy("bucket") \
        .parquet(path)
    return path


def write_version(rows: DataFrame, root: str, version: int, buckets: int = BUCKETS) -> None:
    """Write one version; its run is replaced as a whole."""
    _write_run(rows.withColumn("version", F.lit(version).cast("long")), root, 0, version, version, buckets)


def list_runs(spark: SparkSession, root: str, buckets: int = BUCKETS) -> list[tuple[int, int, int, str]]:
    """(level, first, last, path) of every finished run."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(f"{root}/buckets={buckets}")
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for entry in system.globStatus(hadoop.Path(top, "level=*/run=*/_SUCCESS")) or []:
        run = entry.getPath().getParent()
        first, last = run.getName().removeprefix("run=").split("_")
        found.append((int(run.getParent().getName().removeprefix("level=")), int(first), int(last), run.toString()))
    return sorted(found)


def _covered(run, runs) -> bool:
    level, first, last, _ = run
    return any(r[0] > level and r[1] <= first and last <= r[2] for r in runs)


def compact_levels(spark: SparkSession, root: str, before: int, buckets: int = BUCKETS, fanout: int = FANOUT) -> None:
    """Merge each level with ``fanout`` runs of versions before ``before``
    into one run of the next level; remove runs merged earlier."""
    runs = list_runs(spark, root, buckets)
    old = [r for r in runs if r[2] < before and _covered(r, runs)]
    hadoop = spark._jvm.org.apache.hadoop.fs
    for _, _, _, path in old:
        gone = hadoop.Path(path)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    live = [r for r in runs if r not in old and r[2] < before]
    level = 0
    while any(r[0] >= level for r in live):
        mine = [r for r in live if r[0] == level]
        if len(mine) >= fanout:
            first, last = min(r[1] for r in mine), max(r[2] for r in mine)
            rows = spark.read.schema(_STORED).option("basePath", root).parquet(*[r[3] for r in mine]).select(*_FIELDS, "version")
            path = _write_run(_latest(rows), root, level + 1, first, last, buckets)
            live = [r for r in live if r[0] != level] + [(level + 1, first, last, path)]
        level += 1


def compact(spark: SparkSession, root: str, target: str, seq: int, buckets: int = BUCKETS) -> None:
    """Write the state before ``seq`` into a new root as one run, laid out by
    date inside each bucket so that date filters skip row groups."""
    rows = current(spark, root, seq).withColumn("version", F.lit(seq - 1).cast("long"))
    _write_run(rows, target, 0, seq - 1, seq - 1, buckets, ("start_date", "id"))


def read_table(spark: SparkSession, path: str, schema=STAGED_SCHEMA) -> DataFrame:
    """A table written by an older schema, shaped to the present one."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path), schema)

"""Session settings and the few helpers that touch the session itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows up to which a dimension may be broadcast; counted, never assumed
BROADCAST_ROWS = 200_000
#: rows of heavy per-row work that one task does
TASK_ROWS = 50_000


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE, Arrow).

    The number of shuffle partitions is left to the caller: AQE coalesces
    small ones, and a cluster sets it from its own core count.
    """
    builder = SparkSession.builder.appName("playbill")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sized_broadcast(dim: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``dim`` only when a bounded count proves it small.

    ``limit(max_rows + 1)`` caps the cost of the check itself.  Larger
    dimensions are returned as they are and join by shuffle.
    """
    return F.broadcast(dim) if dim.limit(max_rows + 1).count() <= max_rows else dim


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.
    Only a local session that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for results that several
    branches read or that end a round of a loop.  Unlike a cache it survives
    lost executors, plans after it start small and prune its columns, and its
    size is known when a join is planned.
    """
    return store(df, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")


def store(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Use all cores for heavy per-row work on an input with fewer splits than
    it should have tasks: one per core, and one per ``TASK_ROWS`` rows, so that
    a task does not grow with the input.  An input with enough splits is
    returned as it is.  ``rows`` saves the count, which a stored table answers
    from its footers."""
    rows = df.count() if rows is None else rows
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df

"""New observation files merged as they arrive.

``foreachBatch`` runs the batch merge.  A batch reads the buckets its ids fall
in, of versions before its own, and replaces its own run, so replaying it
after a failure changes nothing.  Older runs are then compacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from playbill.operators.merge import collapse_batch, merge_observations
from playbill.schema import EVENT_SCHEMA
from playbill.operators.identity import stable_id
from playbill.session import cut_lineage
from playbill.sources.staged import compact_levels, current, touched_buckets, write_version

OBSERVED_AT = T.StructField("observed_at", T.TimestampType(), False)
FEED_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, OBSERVED_AT])


def read_observations(spark: SparkSession, path: str, files_per_batch: int | None = None,
                      fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(FEED_SCHEMA).format(fmt)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def apply_batch(batch: DataFrame, batch_id: int, root: str, default_status: str = "pending") -> None:
    """Merge one micro-batch.  Only buckets the batch touches are read, and
    only ids it touches are written."""
    spark = batch.sparkSession
    rows = cut_lineage(collapse_batch(batch, F.col("observed_at")))
    touched = touched_buckets(rows.select(stable_id(F.col("source"), F.col("source_url")).alias("id")))
    stored = current(spark, root, before=batch_id, touched=touched)
    merged = merge_observations(stored, rows, F.col("observed_at"), default_status,
                                keep_unseen=False)
    write_version(merged, root, batch_id)
    compact_levels(spark, root, before=batch_id)


def ingest(observations: DataFrame, root: str, checkpoint: str,
           default_status: str = "pending") -> StreamingQuery:
    """Start the stream over all files present and stop when they are merged."""
    return observations.writeStream.trigger(availableNow=True) \
        .option("checkpointLocation", checkpoint) \
        .foreachBatch(lambda df, n: apply_batch(df, n, root, default_status)) \
        .start()

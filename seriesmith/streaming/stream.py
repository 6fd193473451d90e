"""Incremental jobs as Structured Streaming: catalogue ingest and daily cover."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_cover(
    stream: DataFrame, keys: Sequence[str], time: str = "time", value: str = "value", event_id: str = "event_id", delay: str = "1 day",
    min_samples: int = 720,
) -> DataFrame:
    """Daily means of late-tolerant, de-duplicated samples; a day is emitted once the watermark has passed it.

    State per key is one open day (plus the ids inside the delay), so it does
    not grow with the length of the stream.
    """
    d = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, event_id])
    g = d.groupBy(*keys, F.window(time, "1 day").alias("_w")).agg(F.avg(value).alias(value), F.count(value).alias("n_samples"))
    return g.where(F.col("n_samples") >= min_samples).select(*keys, F.to_date("_w.start").alias("date"), value, "n_samples")


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is available now and stop; a later run goes on from the checkpoint."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def incremental_ingest(
    spark: SparkSession, source: DataFrame, root: str, key: str = "path", order: str = "modified"
) -> StreamingQuery:
    """Keep the newest row per path as keyed state of the stream and write each batch's changes below ``root``.

    A streaming maximum holds one row per path, the one of the highest ``order`` (equal ones: the larger row, so that the
    result does not hang on arrival; a NULL order is the lowest). The state lives on disk beside the checkpoint, with versions:
    a restart goes on from the last finished batch, and a replayed batch starts from the state before it and rewrites its
    own folder of changes. ``read_catalog`` reads the state, not the batches. The number of shuffle partitions is fixed by
    the first run.
    """
    rest = [order, *[c for c in source.columns if c not in (key, order)]]
    newest = source.groupBy(key).agg(F.max(F.struct(*rest)).alias("row"))

    def note(batch: DataFrame, batch_id: int) -> None:
        batch.select(key, "row.*").write.mode("overwrite").parquet(os.path.join(root, "changes", f"batch={batch_id}"))

    # a query takes the store's kind from the session at its start
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            newest.writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", os.path.join(root, "checkpoint"))
            .trigger(availableNow=True).start())
    finally:
        spark.conf.set(PROVIDER, before)


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Current catalogue, one row per path: the state after the last batch, whatever the number of batches."""
    state = spark.read.format("statestore").load(os.path.join(root, "checkpoint"))
    (held,) = state.schema["value"].dataType.names
    return state.select("key.*", f"value.{held}.*")


def read_changes(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """The rows of the catalogue that one batch added or replaced (or met again), for consumers that follow the stream."""
    return spark.read.parquet(os.path.join(root, "changes", f"batch={batch}"))

"""Stock movement over arriving snapshots.

Every micro-batch is stored under its batch id, so a replay overwrites its own rows and a
date may arrive in several batches.  The date pairs a batch touches are then computed again
from the store.  A log of (event_date, batch_id) says which result of a date is current.
An empty table of the events' columns lies beside them, since batches without events store no file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from stockloom.operators import movement as mv


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def process_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Store one batch and renew the events of the date pairs it touches; safe to repeat."""
    spark = batch.sparkSession
    _write(batch.withColumn("batch_id", F.lit(batch_id)), f"{path}/snapshots", "snapshot_date", "batch_id")
    store = spark.read.schema(batch.schema.add("batch_id", "long")).parquet(f"{path}/snapshots")
    touched = store.filter(F.col("batch_id") == batch_id).select("snapshot_date").distinct()
    pairs = mv.date_pairs(store.select("snapshot_date"))
    hit = pairs.join(touched, pairs.current_date == touched.snapshot_date, "left_semi").unionByName(
        pairs.join(touched, pairs.previous_date == touched.snapshot_date, "left_semi")).distinct()
    events = mv.all_deltas(store.drop("batch_id"), hit)
    _write(events.withColumn("batch_id", F.lit(batch_id)), f"{path}/events", "event_date", "batch_id")
    spark.createDataFrame([], events.schema).write.mode("overwrite").parquet(f"{path}/columns")
    _write(hit.select(F.col("current_date").alias("event_date"), F.lit(batch_id).alias("batch_id")), f"{path}/log", "batch_id")


def stream_movement(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over everything available, then stop."""
    return (
        stream.writeStream.foreachBatch(lambda df, i: process_batch(df, i, path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_movement(spark: SparkSession, path: str) -> DataFrame:
    """Current events: of every date, the result of the last batch that renewed it."""
    columns = spark.read.parquet(f"{path}/columns").schema
    log = StructType([columns["event_date"], StructField("batch_id", LongType())])
    last = spark.read.schema(log).parquet(f"{path}/log").groupBy("event_date").agg(F.max("batch_id").alias("batch_id"))
    events = spark.read.schema(columns.add("batch_id", "long")).parquet(f"{path}/events")
    return events.join(last, ["event_date", "batch_id"], "left_semi").drop("batch_id")

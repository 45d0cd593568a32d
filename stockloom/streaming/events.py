"""Event streams: intake, daily counts, last seen and latest run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockloom.operators import events as ev


def run_available(df: DataFrame, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Rows under their batch id: a replayed batch replaces itself."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    return write


def intake(stream: DataFrame, good_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Valid events to one table, events without any user to another."""
    def write(df: DataFrame, batch_id: int) -> None:
        good, bad = ev.clean_events(df)
        _by_batch(good_path)(good, batch_id)
        _by_batch(bad_path)(bad, batch_id)
    return run_available(stream, "append", checkpoint, write)


def daily_counts(stream: DataFrame, value: Column, path: str, checkpoint: str, keys: Sequence[str] = ("region",), watermark: str = "1 day") -> StreamingQuery:
    """Closed days only; later events than the watermark are dropped by Spark."""
    return run_available(ev.daily_counts(stream, value, keys, watermark), "append", checkpoint, _by_batch(path))


def last_seen(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("event", "region")) -> StreamingQuery:
    """Newest time per key; state is one row per key."""
    return run_available(stream.groupBy(*keys).agg(F.max("ts").alias("last_seen")), "update", checkpoint, _by_batch(path))


def latest_execution(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("service", "region")) -> StreamingQuery:
    return run_available(ev.latest_execution(stream, keys), "update", checkpoint, _by_batch(path))


def current_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest update per key of a table written by an update-mode stream."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_l")).select(*keys, "_l.*").drop("batch_id")

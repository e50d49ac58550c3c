"""Structured Streaming over event tables: an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, folder: str, schema: T.StructType | str, files_at_once: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window and keys; rows later than ``late`` are left out and state is dropped."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts by session: events of a key less than ``gap`` apart."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", *keys, "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs all there is to a table in memory and returns it; for small results and tests."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Exactly once to Parquet: the checkpoint holds what was written."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

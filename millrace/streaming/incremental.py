"""Structured Streaming forms of incremental reading and of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_available(spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, fmt: str = "parquet", pattern: str | None = None) -> int:
    """Everything new under `path` since the last call, appended to the Parquet table `out`; the number of rows.

    The checkpoint holds the marks, so each file is taken exactly once, also after a failure.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    query = reader.load(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def windowed_counts(events: DataFrame, at: str, key: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per key and tumbling (or sliding) window; on a stream, rows more than `late` behind are dropped."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return timed.groupBy(w.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n_events")


def session_counts(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream (or a table) by Spark's own session windows."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    w = F.session_window(at, gap)
    return timed.groupBy(w.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("started_at"), "n_events")

"""Structured Streaming over the events: windowed counts with late data, running transitions, incremental edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, users): counts by window; works on streams, whose state the watermark bounds, and on tables."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "users")


def splice(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges after some files (file) were read again: their old edges go, fresh ones come."""
    return edges.join(changed, "file", "anti").unionByName(fresh)

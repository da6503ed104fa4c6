"""Structured Streaming over events: windows, sessions, edge counts, what is new since a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, value: tumbling or sliding windows, with late events up to a bound."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of each session."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def edge_counts(events: DataFrame) -> DataFrame:
    """src, rel, dst, weight: edges from users to kinds of events, as they grow; sources whose walks grow stale."""
    src, dst = F.concat(F.lit("Customer/"), F.col("user_id").cast("string")), F.concat(F.lit("EventKind/"), F.col("event_type"))
    return events.groupBy(src.alias("src"), F.col("event_type").alias("rel"), dst.alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def since(events: DataFrame, at: str) -> DataFrame:
    return events.filter(F.col("ts") >= F.to_timestamp(F.lit(at)))

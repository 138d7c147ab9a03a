"""Structured Streaming forms of operators that read arriving events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Adds event_time of integer seconds, and its watermark."""
    return events.withColumn("event_time", F.timestamp_seconds("time")).withWatermark("event_time", lateness)


def time_profile(events: DataFrame, size: int, lateness: str = "10 minutes") -> DataFrame:
    """Counts of events in buckets of `size` seconds, each once its time has passed."""
    w = F.window("event_time", f"{size} seconds")
    return with_event_time(events, lateness).groupBy(w).agg(F.count("*").alias("line_count")).select(F.unix_seconds("window.start").alias("bucket_start"), "line_count")


def first_seen_edges(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first arrival of each edge, ever; state grows with the edges, not with the events, and lies in the state store."""
    return events.dropDuplicates(keys)


def bursts(events: DataFrame, host: str, seconds: int, slide: int, threshold: int, lateness: str = "10 minutes") -> DataFrame:
    """Hosts with `threshold` events or more in a sliding window."""
    w = F.window("event_time", f"{seconds} seconds", f"{slide} seconds")
    return with_event_time(events, lateness).groupBy(w, host).agg(F.count("*").alias("n")).filter(F.col("n") >= threshold).select(F.unix_seconds("window.start").alias("start"), host, "n")


def gap_sessions(signals: DataFrame, gap: int, lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a source and user that end after `gap` silent seconds. The batch rule closes episodes by the next event of any
    key; a stream closes them by the watermark, so a sparse stream may split later than a batch."""
    w = F.session_window("event_time", f"{gap} seconds")
    return with_event_time(signals, lateness).groupBy(w, "source", "user").agg(F.count("*").alias("events_count"), F.approx_count_distinct("dest").alias("destinations")).select("source", "user", F.unix_seconds("session_window.start").alias("start_time"), "events_count", "destinations")


def run_to(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes what is available to Parquet, exactly once across restarts."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Streaming variants of batch operators on events: an extension, as the reference reads finished files only.

Each takes a streaming DataFrame with a timestamp column `ts`; late rows are those behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str) -> DataFrame:
    """With a watermark; times without a zone count as of the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def bucket_dedup(events: DataFrame, keys: list[str], bucket: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """One row for each key and time bucket (W3), with the first event id; a bucket is given out when the watermark has passed it."""
    w = F.window("ts", bucket).alias("w")
    return _marked(events, late).groupBy(*keys, w).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select(*keys, F.col("w.start").alias("start"), "event_id")


def sessions(events: DataFrame, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key with no longer gap than this (W1), with their number, begin and end."""
    s = F.session_window("ts", gap).alias("s")
    return _marked(events, late).groupBy(*keys, s).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).select(*keys, "n", "first", "last")


def handoffs(left: DataFrame, right: DataFrame, key: str, low: str, high: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of a key whose second event follows the first by low to high (J3, J4): a stream-stream join whose state the band bounds."""
    a = _marked(left, late).select(F.col(key).alias("k"), F.col("ts").alias("a_ts"), F.col("event_id").alias("a_event_id"))
    b = _marked(right, late).select(F.col(key).alias("k2"), F.col("ts").alias("b_ts"), F.col("event_id").alias("b_event_id"))
    return a.join(b, F.expr(f"k = k2 AND b_ts >= a_ts + INTERVAL {low} AND b_ts <= a_ts + INTERVAL {high}")).drop("k2")


def append(stream: DataFrame, path: str, checkpoint: str):
    """Write what is finished to a table, batch by batch, and end when all input there is has been read (K2, K6)."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

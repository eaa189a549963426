"""Event, entity and track views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest event, in milliseconds; longer values are cut by the adapter, as clips end.
LONGEST_MS = 30_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_view(events: DataFrame) -> DataFrame:
    """event_id, activity, camera_id, actor_id, slot, start_ms, end_ms of raw events; a map over rows.

    Times are milliseconds of the day, so no result hangs on the session's time zone or on rounding."""
    start = (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("long") * 1000 + F.floor(F.expr("extract(SECOND FROM ts)") * 1000).cast("long")
    length = F.floor(F.least(F.col("value"), F.lit(LONGEST_MS / 1000)) * 1000).cast("long")
    return events.select(
        "event_id",
        F.col("event_type").alias("activity"),
        F.concat(F.lit("C"), (F.col("user_id") % 8).cast("string")).alias("camera_id"),
        F.col("user_id").alias("actor_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("slot"),
        start.alias("start_ms"),
        (start + length).alias("end_ms"),
    )


def entity_view(events: DataFrame) -> DataFrame:
    """slot, camera_id, actor_id, first_ms, last_ms, n_events: what an event view says of each actor on a camera."""
    return events.groupBy("slot", "camera_id", "actor_id").agg(F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.count("*").alias("n_events"))

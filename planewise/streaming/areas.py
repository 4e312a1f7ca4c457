"""The same aggregates kept up to date over a stream of voxels or events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.functions.columns import KEYS
from planewise.operators.areas import plane_areas


def streaming_areas(voxels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Running plane areas; counts are associative, so the state is one number for each label and plane."""
    return plane_areas(voxels, keys)


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events in tumbling windows; rows later than ``late`` are left out once their window is closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")

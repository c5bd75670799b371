"""A stream of readings on a regular grid, late ones up to a delay included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gridded(readings: DataFrame, step: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """(sensor_id, start, n, value) of readings(sensor_id, ts, value): counts and means of each window, final once the watermark
    passes it."""
    by = F.window("ts", step)
    return readings.withWatermark("ts", delay).groupBy("sensor_id", by).agg(F.count("value").alias("n"), F.avg("value").alias("value")).select("sensor_id", F.col("window.start").alias("start"), "n", "value")

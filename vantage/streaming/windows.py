"""Windows over event streams: extensions that work on batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """window_start, keys and rows of each window; ``late`` sets the watermark of a stream."""
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    if late and events.isStreaming:
        e = e.withWatermark("_t", late)
    return e.groupBy(F.window("_t", width), *by).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("window_start"), *by, "rows")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """session_start, session_end, keys and rows of runs of events no further apart than ``gap``."""
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    if late and events.isStreaming:
        e = e.withWatermark("_t", late)
    out = e.groupBy(F.session_window("_t", gap), *by).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "rows")


def leases(heartbeats: DataFrame, worker: str, time: str, seconds: int = 90, late: str = "10 minutes") -> DataFrame:
    """Runs of heartbeats of a worker: a lease ends ``seconds`` after its last one."""
    return sessions(heartbeats, time, f"{seconds} seconds", [worker], late)

"""Live status of run steps on a stream of step events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insightspark.streaming.changes import latest_changes


def status_changes(events: DataFrame, run: str = "run_id", expire_after: str | None = None) -> DataFrame:
    """Streaming (run, node, seq, status): the last status of every step.

    The state is one row per step.  For a log without end, ``expire_after``
    (such as '7 days') groups by time window too and forgets a window once the
    watermark on ``ts`` has passed it.
    """
    keys = [F.col(run), F.col("node")]
    if expire_after:
        events = events.withWatermark("ts", expire_after)
        keys.append(F.window("ts", expire_after))
    latest = events.groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status"))
    return latest.select(run, "node", "seq", "status")


def status_now(spark: SparkSession, folder: str, run: str = "run_id") -> DataFrame:
    """(run, node, seq, status) from the written changes."""
    return latest_changes(spark, folder, [run, "node"], "seq")

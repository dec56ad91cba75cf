"""Run state and step status folded from logs of updates and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.functions.numbers import python_round

ERRORS = "errors"


def fold_state(updates: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, field, seq, value): the last write of every field but the errors.

    Each task keeps one row per field before the shuffle, so a run that fills
    the log costs no more than any other.
    """
    writes = updates.where(F.col("field") != ERRORS)
    latest = writes.groupBy(run, "field").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
    return latest.select(run, "field", "seq", "value")


def fold_errors(updates: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, seq, error): all appended errors; ``seq`` is their order.

    Errors stay rows, since nothing bounds their number per run.
    """
    return updates.where(F.col("field") == ERRORS).select(run, "seq", F.col("value").alias("error"))


def step_status(events: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, node, status, elapsed) from (run, node, type, status, ts, seq) events.

    ``status`` is that of the last event.  ``elapsed`` is the time from the last
    start to the last completion in seconds, to one decimal; null while running.
    """
    started = F.max(F.when(F.col("type") == "node_start", F.col("ts")))
    completed = F.max(F.when(F.col("type") == "node_complete", F.col("ts")))
    steps = events.groupBy(run, "node").agg(
        F.max_by("status", "seq").alias("status"), started.alias("started"), completed.alias("completed")
    )
    micros = F.timestamp_diff("MICROSECOND", F.col("started"), F.col("completed"))
    elapsed = F.when(micros >= 0, python_round(micros / 1_000_000.0, 1))
    return steps.select(run, "node", "status", elapsed.alias("elapsed"))

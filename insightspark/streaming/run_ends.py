"""Runs that end or stall, on a stream of step events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The event types after which a run has no more events.
LAST_EVENTS = ("result", "error")
# Runs are dealt by hash into this many buckets, whose open runs are folded together.
BUCKETS = 4096
_OUT = "outcome string, status string, node string, seq bigint, events bigint, last bigint"
_BUCKET = "_bucket"


def run_ends(events: DataFrame, stalled_after: str, run: str = "run_id", buckets: int = BUCKETS) -> DataFrame:
    """Streaming (run, outcome, status, node, seq, events, last): a row when a run ends, and one when it stalls.

    ``events`` has the run, node, type, status, ts and seq.  A run ends with its last event, a 'result' or
    'error', and is then forgotten.  One that had no event for ``stalled_after`` (such as '10 minutes') of the log's time is
    reported as 'stalled' with the step it is in, and forgotten too; later events begin it anew.

    The state is a row per bucket of runs that has open ones, and holds these as an Arrow table: a call of Python folds all events
    of a bucket, so its cost does not grow with the number of runs.  A batch rewrites the open runs of the buckets it has events of;
    more ``buckets`` make these smaller.  Events of a bucket meet in one task in batches, of which only the sums per run are kept.
    Events may come out of order: ``seq`` tells which is newest.  Those that come after the end of their run begin a new one, those
    later than ``stalled_after`` and those without run, ts or seq are left out.
    """
    kind = events.schema[run].dataType.simpleString()

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        runs = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        if runs is not None:
            runs = runs.assign(ended=False, fresh=False)
        if not state.hasTimedOut:
            for rows in batches:
                new = rows.drop(columns=[_BUCKET, "type", "ts"]).assign(events=1, due=0, ended=rows["type"].isin(LAST_EVENTS), fresh=True)
                runs = _sums(new if runs is None else pd.concat([runs, new], ignore_index=True), run)
        if runs is None:
            return
        # The watermark is the log's time less the wait, so it passes a run's last event once the wait is over.
        fresh, ended = runs["fresh"].to_numpy(), runs["ended"].to_numpy()
        due = np.where(fresh, np.maximum(runs["last"].to_numpy() // 1000, watermark + 1), runs["due"].to_numpy())
        stalled = ~fresh & (due < watermark)
        kept = ~ended & ~stalled
        if kept.any():
            table = pa.Table.from_pandas(runs.assign(due=due)[kept].drop(columns=["ended", "fresh"]), preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(int(max(due[kept].min(), watermark + 1)))
        elif state.exists:
            state.remove()
        if not kept.all():
            gone = runs.assign(outcome=np.where(ended, "ended", "stalled"))[~kept]
            yield gone[[run, "outcome", "status", "node", "seq", "events", "last"]]

    needed = events.select(run, "node", "type", "status", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("seq"))
    needed = needed.na.drop(subset=[run, "ts", "seq"]).withWatermark("ts", stalled_after)
    dealt = needed.withColumn("last", F.unix_micros("ts")).withColumn(_BUCKET, F.pmod(F.xxhash64(run), F.lit(buckets)))
    ends = dealt.groupBy(_BUCKET).applyInPandasWithState(
        fold, f"`{run}` {kind}, {_OUT}", "open binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return ends.withColumn("last", F.timestamp_micros("last"))


def _sums(rows: pd.DataFrame, run: str) -> pd.DataFrame:
    """A row per run: what its newest row says, with the sums of all; of equal ``seq`` the later row is newer."""
    codes, _ = pd.factorize(rows[run])
    order = np.lexsort((rows["seq"].to_numpy(), codes))
    codes = codes[order]
    begins = np.flatnonzero(np.diff(codes, prepend=-1))
    newest = order[np.append(begins[1:], len(order)) - 1]

    def folded(how: np.ufunc, name: str) -> np.ndarray:
        return how.reduceat(rows[name].to_numpy()[order], begins)

    return rows.iloc[newest].assign(
        events=folded(np.add, "events"), last=folded(np.maximum, "last"), due=folded(np.maximum, "due"),
        ended=folded(np.logical_or, "ended"), fresh=folded(np.logical_or, "fresh"),
    ).reset_index(drop=True)


def start(ends: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the ends of runs to ``folder`` as they come."""
    writer = ends.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(folder) if available_now else writer.start(folder)

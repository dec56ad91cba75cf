"""Runs that end or stall, and rows that repeat across arriving files."""

import pytest
from pyspark.sql import functions as F

from insightspark.operators.clean import drop_duplicate_rows
from insightspark.streaming import arrivals, run_ends

EVENTS = "run_id string, node string, type string, status string, ts timestamp, seq bigint"


def drop(spark, inbox, rows):
    """One more file of events; times are minutes."""
    frame = spark.createDataFrame([(r, n, t, s, None if m is None else 1_700_000_000 + m * 60, q) for r, n, t, s, m, q in rows], EVENTS.replace("ts timestamp", "ts bigint"))
    frame.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(inbox)


def follow(spark, tmp_path, wait="10 minutes"):
    stream = arrivals.arriving_files(spark, str(tmp_path / "in"), EVENTS, kind="parquet", files_per_trigger=1)
    query = run_ends.start(run_ends.run_ends(stream, wait), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    rows = sorted(tuple(r) for r in found.select("run_id", "outcome", "status", "node", "seq", "events").collect())
    return rows, query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_ends_and_stalls_over_drops(spark, tmp_path):
    inbox = str(tmp_path / "in")
    drop(spark, inbox, [
        ("a", "load", "node_start", "starting", 0, 1), ("a", "load", "node_complete", "loaded", 1, 2), ("b", "load", "node_start", "starting", 1, 1),
        (None, "x", "result", "lost", 1, 1), ("c", "x", "node_start", "no time", None, 1),
    ])
    rows, open_runs = follow(spark, tmp_path)
    assert rows == [] and open_runs == 2
    # Out of order: the last event is in an earlier row of the file.
    drop(spark, inbox, [("a", "report", "result", "done", 3, 4), ("a", "report", "node_start", "writing", 2, 3)])
    rows, open_runs = follow(spark, tmp_path)
    assert rows == [("a", "ended", "done", "report", 4, 4)] and open_runs == 1
    # Half an hour later another run begins and fails: run b has stalled in its first step.
    drop(spark, inbox, [("d", "load", "error", "failed", 30, 1)])
    rows, open_runs = follow(spark, tmp_path)
    assert rows == [("a", "ended", "done", "report", 4, 4), ("b", "stalled", "starting", "load", 1, 1), ("d", "ended", "failed", "load", 1, 1)]
    assert open_runs == 0


def test_a_run_in_many_batches_is_counted_once(spark, tmp_path):
    inbox = str(tmp_path / "in")
    for i in range(3):
        drop(spark, inbox, [("hot", f"n{i}", "node_complete", f"s{j}", i, 1000 * i + j) for j in range(50)])
    drop(spark, inbox, [("hot", "end", "result", "done", 4, 9999)])
    rows, open_runs = follow(spark, tmp_path)
    assert rows == [("hot", "ended", "done", "end", 9999, 151)] and open_runs == 0


ROWS = [(1, "a", 0.0, None), (1, "a", -0.0, None), (1, None, 1.5, b"x"), (None, "1", 1.5, b"x"), (1, "a", 0.0, b""), (2, "a\",\"b", 2.0, None)]


def test_rows_that_repeat_across_files(spark, tmp_path, rows):
    schema = "k bigint, t string, d double, raw binary"
    inbox = str(tmp_path / "in")
    for part in (ROWS[:3], ROWS[2:], ROWS):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
    found = []
    for _ in range(2):  # the second run finds no new file
        stream = arrivals.arriving_files(spark, inbox, schema, kind="parquet", files_per_trigger=1, arrived="_arrived")
        fresh = arrivals.first_arrivals(stream, "1 day").drop("_arrived")
        fresh.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
        found.append(rows(spark.read.parquet(str(tmp_path / "o"))))
    expected = rows(drop_duplicate_rows(spark.createDataFrame(ROWS, schema)))
    assert found == [expected, expected]


def test_keys_tell_rows_apart(spark):
    values = [(None, "a"), ("a", None), ("null", "a"), ("a,b", ""), ("a", "b"), ('a","b', None), ("", ""), (None, None)]
    frame = spark.createDataFrame(values, "x string, y string")
    assert frame.select(arrivals.row_key(frame, ["x", "y"])).distinct().count() == len(values)
    micro = spark.sql("SELECT explode(array(timestamp'2024-01-01 00:00:00.000001', timestamp'2024-01-01 00:00:00.000002')) AS t")
    nested = micro.select(F.struct("t").alias("s"), F.array("t").alias("a"))
    assert nested.select(arrivals.row_key(nested, ["s"])).distinct().count() == 2
    assert nested.select(arrivals.row_key(nested, ["a"])).distinct().count() == 2


@pytest.mark.parametrize("text, expected", [
    ('a,b\n"one\ntwo",1\n"x ""y""\n",2\n', [("one\ntwo", 1, []), ('x "y"\n', 2, [])]),
    ('a,b\n"one\ntwo",bad\n"three\n,four",5,6\n', [("one\ntwo", None, ["b"]), ("three\n,four", 5, ["cells"])]),
    ('a,b\nz,1\n"never\nclosed,2\n', [("never\nclosed,2\n", None, ["cells"]), ("z", 1, [])]),
])
def test_line_breaks_in_quotes_of_a_stream(spark, tmp_path, text, expected):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(text)
    stream = arrivals.arriving_files(spark, str(tmp_path / "in"), "a string, b int")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
    assert sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()), key=repr) == sorted(expected, key=repr)


def test_runs_of_one_bucket_keep_apart(spark, tmp_path):
    """All runs in one call of Python: some end, some stall, the others stay open with their own times."""
    inbox = str(tmp_path / "in")

    def go():
        stream = arrivals.arriving_files(spark, inbox, EVENTS, kind="parquet", files_per_trigger=1)
        ends = run_ends.run_ends(stream, "10 minutes", buckets=1)
        query = run_ends.start(ends, str(tmp_path / "out"), str(tmp_path / "c"))
        query.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).select("run_id", "outcome", "status", "node", "seq", "events", F.unix_timestamp("last"))
        return sorted(tuple(r) for r in rows.collect()), query.lastProgress["stateOperators"][0]["numRowsTotal"]

    at = 1_700_000_000
    drop(spark, inbox, [(f"r{i}", "load", "node_start", None, i % 3, i) for i in range(300)])
    assert go() == ([], 1)
    drop(spark, inbox, [(f"r{i}", None, "result" if i < 100 else "node_complete", f"s{i}", 12, 1000 + i) for i in range(200)])
    ended = [(f"r{i}", "ended", f"s{i}", None, 1000 + i, 2, at + 720) for i in range(100)]
    # The log is at minute 12 now, so what was last heard of before minute 2 has stalled.
    stalled = [(f"r{i}", "stalled", None, "load", i, 1, at + i % 3 * 60) for i in range(200, 300) if i % 3 < 2]
    assert go() == (sorted(ended + stalled, key=str), 1)
    drop(spark, inbox, [("r150", "x", "error", "late", 12, 5), ("new", "x", "node_start", "on", 40, 1)])
    rows, _ = go()
    assert ("r150", "ended", "s150", None, 1150, 3, at + 720) in rows
    assert ("r299", "stalled", None, "load", 299, 1, at + 120) in rows
    assert len(rows) == 300 and len({r[0] for r in rows}) == 300

"""Streams over files that arrive in drops equal the batch result."""

import pytest
from pyspark.sql import functions as F

from insightspark.operators.revenue import revenue_by_dimension
from insightspark.streaming import arrivals, step_status
from insightspark.streaming.changes import write_changes

SCHEMA = "` Region ` string, Total_Revenue double"
DROPS = [
    " Region ,Total_Revenue\nsouth,1.5\n  west ,2\n",
    " Region ,Total_Revenue\nsouth,NA\nNULL,5\nnorth,None\n",
    " Region ,Total_Revenue\nwest,0.25\nsouth,10\n",
]


def test_revenue_over_three_drops(spark, tmp_path, rows):
    inbox, out = tmp_path / "inbox", tmp_path / "out"
    inbox.mkdir()
    for i, drop in enumerate(DROPS):
        (inbox / f"drop{i}.csv").write_text(drop)
        # Started anew for every drop: the checkpoint remembers what was read.
        stream = arrivals.clean_stream(arrivals.arriving_files(spark, str(inbox), SCHEMA, files_per_trigger=1))
        changes = arrivals.revenue_changes(stream, "region")
        write_changes(changes, str(out), str(out / "checkpoint"), keys=["key"], snapshot_every=2).awaitTermination()
    assert rows(arrivals.revenue_so_far(spark, str(out))) == [("north", 0.0), ("south", 11.5), ("west", 2.25)]
    # Written in update mode: the second drop did not touch the west.
    second = spark.read.parquet(str(out / "changes" / "batch=1"))
    assert sorted(r.key for r in second.collect()) == ["north", "south"]


@pytest.mark.parametrize("expire_after", [None, "1 day"])
def test_step_status_over_three_drops(spark, tmp_path, rows, expire_after):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("node"), F.col("props").alias("status"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )
    inbox, out = str(tmp_path / "inbox"), tmp_path / "out"
    events.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(inbox)
    stream = arrivals.arriving_files(spark, inbox, events.schema, kind="parquet", files_per_trigger=1)
    changes = step_status.status_changes(stream, expire_after=expire_after)
    write_changes(changes, str(out), str(out / "checkpoint"), keys=["run_id", "node"], order="seq", snapshot_every=2).awaitTermination()
    expected = events.groupBy("run_id", "node").agg(F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status"))
    assert rows(step_status.status_now(spark, str(out))) == rows(expected)


def test_a_repeated_batch_leaves_no_doubles(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "region string, total_revenue double")
    df.coalesce(1).write.parquet(str(tmp_path / "inbox"))
    for attempt in range(2):
        stream = arrivals.arriving_files(spark, str(tmp_path / "inbox"), df.schema, kind="parquet")
        changes = arrivals.revenue_changes(stream, "region")
        # A lost checkpoint replays the batch under the same number.
        write_changes(changes, str(tmp_path / "changes"), str(tmp_path / f"checkpoint{attempt}")).awaitTermination()
    assert rows(arrivals.revenue_so_far(spark, str(tmp_path / "changes"))) == rows(revenue_by_dimension(df, "region"))


def test_a_read_takes_the_snapshot_and_later_batches_only(spark, tmp_path, rows):
    df = spark.createDataFrame([(f"k{i}", float(i)) for i in range(7)], "region string, total_revenue double")
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    for i in range(7):
        df.where(F.col("region") == f"k{i}").coalesce(1).write.mode("append").parquet(inbox)
    stream = arrivals.arriving_files(spark, inbox, df.schema, kind="parquet", files_per_trigger=1)
    write_changes(arrivals.revenue_changes(stream, "region"), out, str(tmp_path / "c"), keys=["key"], snapshot_every=3).awaitTermination()
    found = arrivals.revenue_so_far(spark, out)
    assert rows(found) == rows(revenue_by_dimension(df, "region"))
    files = " ".join(found.inputFiles())
    assert "upto=5" in files and "upto=2" not in files and "batch=6" in files
    assert not any(f"batch={n}/" in files for n in range(6))


def test_old_batches_and_snapshots_go(spark, tmp_path, rows):
    """However many batches there were, a read lists two rounds of them and two snapshots at most."""
    df = spark.createDataFrame([(f"k{i % 4}", float(i)) for i in range(16)], "region string, total_revenue double")
    inbox, out = str(tmp_path / "inbox"), tmp_path / "out"
    for i in range(16):
        df.where(F.col("total_revenue") == i).coalesce(1).write.mode("append").parquet(inbox)
    for _ in range(2):  # the second start finds nothing new
        stream = arrivals.arriving_files(spark, inbox, df.schema, kind="parquet", files_per_trigger=1)
        write_changes(arrivals.revenue_changes(stream, "region"), str(out), str(tmp_path / "c"), keys=["key"], snapshot_every=3).awaitTermination()
        assert rows(arrivals.revenue_so_far(spark, str(out))) == rows(revenue_by_dimension(df, "region"))
    assert sorted(p.name for p in (out / "snapshots").glob("upto=*")) == ["upto=11", "upto=14"]
    assert sorted(int(p.name.split("=")[1]) for p in (out / "changes").glob("batch=*")) == [12, 13, 14, 15]


def test_a_stream_without_a_file_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    stream = arrivals.arriving_files(spark, str(tmp_path / "inbox"), "region string, total_revenue double")
    write_changes(arrivals.revenue_changes(stream, "region"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert arrivals.revenue_so_far(spark, str(tmp_path / "out")).collect() == []


def test_rejects_of_a_stream(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.csv").write_text("a,b\n1,x\nbad,y\n4,5,6\nNA,z\n")
    stream = arrivals.arriving_files(spark, str(inbox), "a int, b string")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
    found = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()), key=repr)
    assert found == sorted([(1, "x", []), (None, "y", ["a"]), (4, "5", ["cells"]), (None, "z", [])], key=repr)


def test_another_header_stops_the_stream(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.csv").write_text("b,a\nx,1\n")
    stream = arrivals.arriving_files(spark, str(inbox), "a int, b string")
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)header"):
        query.awaitTermination()

"""Records with line breaks in quotes from files that are cut anywhere, against Python's csv module."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from insightspark.errors import DataIngestionError
from insightspark.sources.csv_files import load_table
from insightspark.sources.csv_records import BlockStarts, _states, ends_inside, record_texts

CELLS = ["", "plain", "two\nlines", 'say "hi"', '"', '""', "a,b", ',"\n', "\n\n", 'end"\n"', '5" pipe', " lead", "é\nü", "x\n,y,\n\"z\"", "1"]


@pytest.fixture
def small_blocks(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "200")
    spark.conf.set(names[1], "1")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def table_text(rng, rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "a", "b"])
    data = [(i, rng.choice(CELLS), rng.choice(CELLS)) for i in range(rows)]
    writer.writerows(data)
    return out.getvalue(), data


@pytest.mark.parametrize("seed", range(4))
def test_files_of_many_blocks(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    expected = []
    for name in ("a.csv", "b.csv"):
        text, data = table_text(rng, 300)
        (tmp_path / name).write_text(text)
        expected += data
    found = load_table(spark, str(tmp_path), "id string, a string, b string")
    assert found.rdd.getNumPartitions() > 20
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    clean = [(str(i), a or None, b or None) for i, a, b in expected]
    assert sorted(((r.id, r.a, r.b) for r in found.collect()), key=repr) == sorted(clean, key=repr)


def test_more_than_one_task_makes_records(spark, tmp_path, small_blocks):
    text, _ = table_text(random.Random(9), 200)
    (tmp_path / "a.csv").write_text(text)
    tasks = record_texts(spark, str(tmp_path / "a.csv")).where("NOT first").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 5


def test_a_record_longer_than_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}, \"quoted\"" for i in range(200))
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["a", "b"], ["1", long], ["2", "x"], ["3", long], ["4", long]])
    (tmp_path / "a.csv").write_text(out.getvalue())
    assert sorted(map(tuple, load_table(spark, str(tmp_path)).collect())) == [(1, long), (2, "x"), (3, long), (4, long)]


def test_inch_marks_are_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n5" pipe,1\n6" pipe,2\nx"y"z,3\n')
    assert [tuple(r) for r in load_table(spark, str(tmp_path)).collect()] == [('5" pipe', 1), ('6" pipe', 2), ('x"y"z', 3)]
    (tmp_path / "a.csv").write_text('a,b\n5" pipe,1\n"two\nlines",2\n6" pipe,3\n')
    assert sorted(map(tuple, load_table(spark, str(tmp_path)).collect())) == [('5" pipe', 1), ('6" pipe', 3), ("two\nlines", 2)]


def test_a_quote_never_closed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n"open,3\n4,5\n')
    with pytest.raises(DataIngestionError, match="never closed"):
        load_table(spark, str(tmp_path))


def test_carriage_returns_marks_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('\ufeffa,b\r\n\r\n"x\r\ny",1\r\n   \r\n"z\nw",2'.encode())
    found = sorted((r.a.replace("\r", ""), r.b) for r in load_table(spark, str(tmp_path)).collect())
    assert found == [("x\ny", 1), ("z\nw", 2)]


def test_headers_with_line_breaks(spark, tmp_path, small_blocks):
    name = "very long name\n" * 40
    (tmp_path / "a.csv").write_text(f'"{name}",b\n1,"x\ny"\n')
    table = load_table(spark, str(tmp_path))
    assert table.columns == [name, "b"] and tuple(table.first()) == (1, "x\ny")


@pytest.mark.parametrize("line", ["", "a", '"', '""', '"""', 'a"', 'a,"', '",', '"a"b"', 'x,"y""', '"x","', '"x" "', '5" p,"q', '"a""b",c', ',,"'])
def test_a_line_against_a_walk(spark, line):
    def walk(inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "closed" if c == '"' else "quoted"
            elif c == '"' and state in ("start", "closed"):
                state = "quoted"
            elif c == ",":
                state = "start"
            else:
                state = "text"
        return state == "quoted"

    frame = spark.createDataFrame([(line,)], "value string")
    found = frame.select(ends_inside(F.col("value"), False), ends_inside(F.col("value"), True)).first()
    assert tuple(found) == (walk(False), walk(True))


def test_states_compose():
    rng = np.random.default_rng(3)
    for _ in range(200):
        outcomes, inside = rng.integers(0, 4, 12), bool(rng.integers(0, 2))
        expected, state = [], inside
        for outcome in outcomes:
            state = bool(outcome >> int(state) & 1)
            expected.append(state)
        assert _states(outcomes, inside).tolist() == expected


def test_block_starts():
    starts = BlockStarts([("f", 100, 1), ("f", 0, 3), ("g", 50, 0), ("f", 300, 3)])
    assert [starts.inside("f", b) for b in (0, 50, 100, 150, 300, 400)] == [False, True, True, False, False, True]
    assert not starts.inside("g", 99) and not starts.inside("h", 5) and starts.unclosed == ["f"] and starts.crossed

"""CSV load, null tokens, type inference, text documents, JSON payloads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from insightspark.errors import DataIngestionError, DocumentIngestionError
from insightspark.sources.csv_files import NULL_TOKENS, load_table
from insightspark.sources.payloads import json_rows, result_payload, write_json
from insightspark.sources.text_documents import decode_ignoring_errors, read_text_documents


def write(folder, text, name="table.csv"):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_types_are_inferred_per_column(spark, tmp_path):
    path = write(
        tmp_path,
        "whole,real,flag,text,empty,mixed,padded,huge\n"
        "1,1,True,a,,1, 5 ,99999999999999999999\n"
        "-2,2.5e3,FALSE,TRUE,NA,x,+6,1\n"
        "NULL,inf,,1,n/a,2.5,7,2\n",
    )
    table = load_table(spark, path)
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    assert kinds == {
        "whole": "bigint", "real": "double", "flag": "boolean", "text": "string",
        "empty": "double", "mixed": "string", "padded": "bigint", "huge": "double",
    }
    first, second, third = table.collect()
    assert tuple(first)[:7] == (1, 1.0, True, "a", None, "1", 5)
    assert tuple(second)[:7] == (-2, 2500.0, False, "TRUE", None, "x", 6)
    assert tuple(third)[:7] == (None, float("inf"), None, "1", None, "2.5", 7)


def test_java_suffixes_are_no_numbers(spark, tmp_path):
    table = load_table(spark, write(tmp_path, "a,b\n1d,1f\n2d,2f\n"))
    assert [f.dataType.simpleString() for f in table.schema] == ["string", "string"]


@pytest.mark.parametrize("token", [t for t in NULL_TOKENS if t])
def test_null_tokens(spark, tmp_path, token):
    table = load_table(spark, write(tmp_path, f"a,b\n1,{token}\n{token},x\n"))
    assert [tuple(r) for r in table.collect()] == [(1, None), (None, "x")]


def test_quotes_repeated_and_blank_headers(spark, tmp_path):
    table = load_table(spark, write(tmp_path, 'a,a,,a\n"say ""hi"", twice",2,3,4\n'))
    assert table.columns == ["a", "a.1", "Unnamed: 2", "a.2"]
    assert tuple(table.first()) == ('say "hi", twice', 2, 3, 4)


def test_line_breaks_inside_quotes(spark, tmp_path):
    table = load_table(spark, write(tmp_path, 'a,b\n"one\ntwo",1\n"x ""y""\n",2\n'))
    assert [tuple(r) for r in table.collect()] == [("one\ntwo", 1), ('x "y"\n', 2)]
    assert tuple(load_table(spark, write(tmp_path, '"a\nb",c\n1,2\n', "head.csv")).first()) == (1, 2)


def test_headers_in_another_order(spark, tmp_path):
    for name, text in (("1.csv", "a,b\n1,x\n"), ("2.csv", "b,a\ny,2\n"), ("3.csv", 'a,b\n3,"z\nz"\n'), ("4.csv", "a,b\n4,w\n")):
        write(tmp_path, text, name)
    for schema in (None, "a bigint, b string", "b string, a bigint"):
        found = load_table(spark, str(tmp_path), schema)
        assert sorted((r.a, r.b) for r in found.collect()) == [(1, "x"), (2, "y"), (3, "z\nz"), (4, "w")]


def test_other_names_are_refused(spark, tmp_path):
    write(tmp_path, "a,b\n1,2\n", "1.csv")
    with pytest.raises(DataIngestionError, match="declared"):
        load_table(spark, str(tmp_path), "a int, c int")
    write(tmp_path, "a,c\n1,2\n", "2.csv")
    with pytest.raises(DataIngestionError, match="headers"):
        load_table(spark, str(tmp_path))


def test_unfit_and_extra_cells_are_counted(spark, tmp_path):
    path = write(tmp_path, "a,b\n1,2\nbad,3\n4,5,6\nworse,NA\n")
    with pytest.raises(DataIngestionError, match=r"1 rows have more cells.*'a': 2"):
        load_table(spark, path, "a int, b int")


def test_short_rows_are_filled_and_any_suffix_is_read(spark, tmp_path):
    table = load_table(spark, write(tmp_path, "a,b\n1\n2,3\n", name="table.data"))
    assert [tuple(r) for r in table.collect()] == [(1, None), (2, 3)]


@pytest.mark.parametrize("text", ["", "a,b\n", "a,b\n1,2,3\n"])
def test_unusable_files(spark, tmp_path, text):
    with pytest.raises(DataIngestionError):
        load_table(spark, write(tmp_path, text))


def test_missing_file(spark, tmp_path):
    with pytest.raises(DataIngestionError):
        load_table(spark, str(tmp_path / "none.csv"))


def test_declared_schema(spark, tmp_path):
    path = write(tmp_path, "a,b\n1,NA\nNULL,2.5\n")
    table = load_table(spark, path, schema="a bigint, b double")
    assert [tuple(r) for r in table.collect()] == [(1, None), (None, 2.5)]
    with pytest.raises(DataIngestionError):
        load_table(spark, write(tmp_path, "a,b\n", "empty.csv"), schema="a bigint, b double")


def test_a_folder_of_files(spark, tmp_path):
    for i in range(3):
        write(tmp_path, f"a,b\n{i},x\n", f"part{i}.csv")
    assert sorted(r.a for r in load_table(spark, str(tmp_path)).collect()) == [0, 1, 2]


def test_text_documents(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"ok\xff bytes")
    (tmp_path / "two.md").write_text("# Title\n\nBody �", encoding="utf-8")
    (tmp_path / "three.log").write_text("log\n", encoding="utf-8")
    found = {r.source_file.rsplit("/", 1)[1]: r.text for r in read_text_documents(spark, str(tmp_path)).collect()}
    assert found == {"one.txt": "ok bytes", "two.md": "# Title\n\nBody �", "three.log": "log\n"}
    with pytest.raises(DocumentIngestionError):
        read_text_documents(spark, str(tmp_path / "none.txt"))


def test_decoding_equals_python_on_random_bytes(spark):
    chance = random.Random(7)
    pieces = [b"a", b"\xff", b"\xc3\xa9", b"\xc3", b"\xe2\x82\xac", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\xf0\x9f", b"\x10", b"\x10a", b"\xef\xbf\xbd", b"b", b"\xed\xa0\x80", b"\x80"]
    samples = [b"".join(chance.choice(pieces) for _ in range(chance.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(bytearray(s),) for s in samples], "content binary")
    for row in df.select("content", decode_ignoring_errors(F.col("content")).alias("text")).collect():
        assert row.text == bytes(row.content).decode("utf-8", errors="ignore"), bytes(row.content)


def test_payload_defaults(spark):
    runs = spark.createDataFrame([("r1", ["f"], None, 7), ("r2", None, "s", None)], "run_id string, data_findings array<string>, data_summary string, confidence_score int")
    payloads = {r.run_id: json.loads(r.payload) for r in result_payload(runs).collect()}
    assert payloads["r1"]["data_findings"] == ["f"] and payloads["r1"]["data_summary"] == ""
    assert payloads["r1"]["confidence_score"] == 7 and payloads["r1"]["errors"] == []
    assert payloads["r2"]["data_findings"] == [] and payloads["r2"]["confidence_score"] == 0
    assert payloads["r2"]["report_markdown"] == ""


def test_json_sink_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    write_json(df, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    assert sorted(r.row for r in json_rows(df).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']

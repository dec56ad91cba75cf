"""Cleaning: names, duplicates before trimming, whitespace, dates as a whole or not at all."""

import datetime

import pytest

from insightspark.errors import DataIngestionError
from insightspark.functions.text import strip
from insightspark.operators import clean
from pyspark.sql import functions as F


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["  Order ID ", "A\tB C", "plain"])
    assert clean.normalise_names(df).columns == ["order_id", "a\tb_c", "plain"]


def test_equal_names_are_an_error(spark):
    with pytest.raises(DataIngestionError, match="a"):
        clean.normalise_names(spark.createDataFrame([(1, 2)], ["A ", "a"]))


def test_duplicates_with_nulls(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (None, None), (None, None), (1, "a")], "a int, b string")
    assert rows(clean.drop_duplicate_rows(df)) == [(1, "a"), (1, None), (None, None)]
    assert tuple(clean.duplicate_counts(df).first()) == (5, 3, 2)
    assert tuple(clean.duplicate_counts(df.limit(0)).first()) == (0, 0, 0)


def test_strip_knows_all_of_pythons_whitespace(spark):
    characters = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in characters], "t string")
    assert all(r.s == r.t.strip() for r in df.select("t", strip(F.col("t")).alias("s")).collect())


def test_rows_that_differ_in_whitespace_survive(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a ", 1), ("a", 1)], ["Name", "n"])
    assert rows(clean.clean_table(df)) == [("a", 1), ("a", 1)]


def dates(spark, values, name="date"):
    return clean.parse_dates(spark.createDataFrame([(v,) for v in values], f"`{name}` string"))


@pytest.mark.parametrize(
    "values, expected",
    [
        (["2024-01-05", None, "2023-12-31"], datetime.datetime(2024, 1, 5)),
        (["2024-01-05T10:20:30"], datetime.datetime(2024, 1, 5, 10, 20, 30)),
        (["2024-01-05 10:20:30.123456"], datetime.datetime(2024, 1, 5, 10, 20, 30, 123456)),
        (["2024/1/5"], datetime.datetime(2024, 1, 5)),
        (["01/05/2024", "12/31/2024"], datetime.datetime(2024, 1, 5)),
        (["01/05/2024", "31/12/2024"], datetime.datetime(2024, 5, 1)),
        (["01-05-2024 07:08"], datetime.datetime(2024, 1, 5, 7, 8)),
    ],
)
def test_layouts(spark, values, expected):
    parsed = dates(spark, values)
    assert parsed.schema[0].dataType.simpleString() == "timestamp_ntz"
    found = [r[0] for r in parsed.collect()]
    assert found[0] == expected and (None in values) == (None in found)


@pytest.mark.parametrize(
    "values", [["2024-01-05", "soon"], ["2024-02-30"], ["2024-01-05", "2024-01-05 10:00"], ["01/32/2024"], [""]]
)
def test_one_bad_value_leaves_the_column_alone(spark, values):
    parsed = dates(spark, values)
    assert parsed.schema[0].dataType.simpleString() == "string"
    assert sorted(r[0] for r in parsed.collect()) == sorted(values)


def test_zones_give_instants(spark):
    parsed = dates(spark, ["2024-01-05T10:00:00Z", "2024-01-05T10:00:00+02:00"])
    assert parsed.schema[0].dataType.simpleString() == "timestamp"


def test_only_text_columns_with_date_in_the_name(spark):
    df = spark.createDataFrame([("2024-01-05", "2024-01-05", 20240105, None)], "update_note string, day string, candidate_id int, dates string")
    kinds = [f.dataType.simpleString() for f in clean.parse_dates(df).schema]
    assert kinds == ["timestamp_ntz", "string", "int", "timestamp_ntz"]


def test_clean_table(spark, rows):
    df = spark.createDataFrame(
        [(" x ", "01/02/2024", True), (" x ", "01/02/2024", True), (" y", None, None)], ["Some Name ", "Ship DATE", "Flag"]
    )
    cleaned = clean.clean_table(df)
    assert cleaned.columns == ["some_name", "ship_date", "flag"]
    assert rows(cleaned) == [("x", datetime.datetime(2024, 1, 2), True), ("y", None, None)]

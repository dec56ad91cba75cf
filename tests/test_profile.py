"""Profiles against dataframe models on tables with nulls, ties, NaN and infinities."""

import math

import numpy as np
import pandas as pd
import pytest

from insightspark.operators import profile
from insightspark.operators.quantiles import quantiles
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def table(spark):
    chance = np.random.default_rng(5)
    n = 997
    frame = pd.DataFrame(
        {
            "id": np.arange(n),
            "price": np.where(chance.random(n) < 0.1, np.nan, np.round(chance.lognormal(3, 2, n), 2)),
            "few": chance.integers(0, 4, n),
            "name": [None if x < 0.2 else f"n{int(x * 30)}" for x in chance.random(n)],
            "hot": ["same" if x < 0.9 else f"u{i}" for i, x in enumerate(chance.random(n))],
            "flag": chance.random(n) < 0.5,
        }
    )
    schema = "id bigint, price double, few int, name string, hot string, flag boolean"
    records = frame.astype(object).where(frame.notna(), None).values.tolist()
    return frame, spark.createDataFrame([tuple(r) for r in records], schema).repartition(5).cache()


def test_columns(table):
    frame, df = table
    found = {r.column: r for r in profile.column_profile(df).collect()}
    dtypes = {"id": "int64", "price": "float64", "few": "int64", "name": "object", "hot": "object", "flag": "bool"}
    for name in frame.columns:
        nulls = int(frame[name].isnull().sum())
        row = found[name]
        assert (row.null_count, row.unique_count, row.dtype) == (nulls, frame[name].nunique(), dtypes[name])
        assert row.null_pct == round(nulls / len(frame) * 100, 2)


def test_columns_approximately(table):
    frame, df = table
    for row in profile.column_profile(df, approximate=True).collect():
        assert row.null_count == frame[row.column].isnull().sum()
        assert abs(row.unique_count - frame[row.column].nunique()) <= 0.15 * frame[row.column].nunique() + 1


def test_nan_is_missing_and_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "x double")
    row = profile.column_profile(df).first()
    assert (row.null_count, row.unique_count) == (2, 1)
    assert profile.numeric_summary(df).first()["count"] == 2


def test_numeric_summary(table):
    frame, df = table
    expected = frame[["id", "price", "few"]].describe().round(2)
    for row in profile.numeric_summary(df).collect():
        model = expected[row.column]
        found = [row["count"], row["mean"], row["std"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]]
        assert found == pytest.approx(model.tolist(), abs=0.0101), row.column
        assert found[4:7] == model.tolist()[4:7]


def test_numeric_summary_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5), (float("inf"), None, 5), (-1e300, None, 5), (1e300, None, 5)], "wide double, none double, same int")
    found = {r.column: r for r in profile.numeric_summary(df).collect()}
    assert found["none"]["count"] == 0 and found["none"]["p50"] is None and found["none"]["min"] is None
    assert found["same"]["p25"] == 5.0 and found["same"]["std"] == 0.0
    assert found["wide"]["max"] == math.inf and found["wide"]["min"] == -1e300
    one = profile.numeric_summary(spark.createDataFrame([(3,)], "x int")).first()
    assert (one["p50"], one["std"]) == (3.0, None)
    assert profile.numeric_summary(spark.createDataFrame([("a",)], "x string")).count() == 0


@pytest.mark.parametrize("few", [0, 100, 10_000])
@pytest.mark.parametrize("kind", ["skewed", "copies", "uniform"])
def test_quantiles_are_exact(spark, monkeypatch, few, kind):
    monkeypatch.setattr("insightspark.operators.quantiles._FEW", few)
    chance = np.random.default_rng(11)
    values = {
        "skewed": chance.lognormal(0, 20, 5000),
        "copies": np.concatenate([np.full(3000, 7.25), chance.normal(0, 1, 2001)]),
        "uniform": chance.random(4998),
    }[kind]
    cells = spark.createDataFrame([(float(v),) for v in values], "`0` double").repartition(6)
    bounds = {0: (len(values), float(values.min()), float(values.max()))}
    found = quantiles(cells, bounds, [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0])[0]
    assert found == np.percentile(values, [0, 10, 25, 50, 75, 99.9, 100]).tolist()


def test_top_values(table):
    frame, df = table
    found = {}
    for row in profile.top_values(df).orderBy("column", "rank").collect():
        found.setdefault(row.column, []).append((row.value, row.n))
    for name in ("name", "hot"):
        counts = frame[name].value_counts()
        model = sorted(((k, int(v)) for k, v in counts.items()), key=lambda item: (-item[1], item[0]))[:5]
        assert found[name] == model


def test_date_range(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-05 10:00:00' AS a, timestamp_ntz'2024-01-05 10:00:00.5' AS b, date'2024-02-01' AS c,"
        " cast(null AS timestamp_ntz) AS d, 'x' AS e"
    )
    found = {r.column: (r["min"], r["max"]) for r in profile.date_range(df).collect()}
    assert found == {
        "a": ("2024-01-05 10:00:00",) * 2, "b": ("2024-01-05 10:00:00.500000",) * 2,
        "c": ("2024-02-01 00:00:00",) * 2, "d": ("NaT", "NaT"),
    }


def model_health(frame):
    pcts = [round(int(frame[c].isnull().sum()) / len(frame) * 100, 2) for c in frame.columns]
    duplicates = frame.duplicated().sum() / len(frame) * 100
    scores = [max(0, 100 - sum(pcts) / len(pcts)), min(100, len(frame) / 100 * 10), max(0, 100 - duplicates * 2)]
    return int(sum(scores) / 3)


@pytest.mark.parametrize("columns", [["id", "price", "name"], ["few", "name"], ["hot"], ["price", "flag", "few"]])
def test_health_score(table, columns):
    frame, df = table
    assert profile.health_score(df.select(*columns)).first().data_health_score == model_health(frame[columns])


def test_health_score_of_a_short_and_an_empty_table(spark):
    short = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert profile.health_score(short).first().data_health_score == int((75 + 0.2 + 100) / 3)
    assert profile.health_score(short.limit(0)).first().data_health_score is None


def test_profile_table_has_all_parts(table):
    _, df = table
    parts = profile.profile_table(df)
    assert tuple(parts["shape"].first()) == (997, 6)
    assert set(parts) == {"shape", "columns", "numeric_summary", "categorical_summary", "date_range", "data_health_score"}


def test_stacked_counts_can_be_given(table):
    _, df = table
    counts = profile.value_counts(df).cache()
    assert sorted(map(tuple, profile.column_profile(df, counts=counts).collect())) == sorted(map(tuple, profile.column_profile(df).collect()))
    assert sorted(map(tuple, profile.top_values(df, counts=counts).collect())) == sorted(map(tuple, profile.top_values(df).collect()))
    assert counts.agg(F.sum("n")).first()[0] == 997 * 6


def test_top_values_by_hash_order_ties_by_whole_texts(spark):
    long = "the same beginning of every text " * 400
    rows = [(f"{long}{i:04d}", f"u{i}" if i % 2 else None) for i in range(300)] + [("twice", "")] * 2 + [(None, None)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    found = {(r.column, r["rank"]): (r.value, r.n) for r in profile.top_values(df, 3).collect()}
    assert found == {
        ("a", 1): ("twice", 2), ("a", 2): (f"{long}0000", 1), ("a", 3): (f"{long}0001", 1),
        ("b", 1): ("", 2), ("b", 2): ("u1", 1), ("b", 3): ("u101", 1),
    }
    counts = profile.hashed_counts(df)
    assert not [f for f in counts.schema if f.name == "value" and f.dataType.typeName() == "string"]
    assert max(len(r.prefix or "") for r in counts.collect()) == 16
    assert profile.top_values(df.limit(0)).count() == 0

"""Revenue operators against hand-worked answers: null keys, null sums, ties, gaps."""

import pytest
from pyspark.sql import functions as F

from insightspark.errors import DataIngestionError
from insightspark.functions.numbers import currency_label
from insightspark.operators import chart_data, revenue

SCHEMA = "build_category string, region string, year int, month string, total_revenue double"
ROWS = [
    ("baja_prerunner", "south", 2020, "10", 100.0),
    ("baja_prerunner", "south", 2022, "2", 150.25),
    ("baja_prerunner", "west", 2022, "2", 50.0),
    ("baja_prerunner", "west", 2023, "Jan", 250.5),
    ("Baja kit", "south", 2020, "10", 10.0),
    ("Baja kit", "north", 2022, "10", None),
    ("Baja kit", None, 2023, "2", 12.5),
    ("rock", "west", 2020, "Jan", 400.0),
    ("rock", "west", 2023, "Jan", 80.0),
    ("daily", "north", 2023, "2", float("nan")),
    (None, "south", 2022, "10", 30.0),
    (None, None, 2020, "Jan", 5.0),
]
# Worked out by hand from ROWS.
BY_REGION = {"west": 780.5, "south": 290.25, "north": 0.0}
BY_CATEGORY = {"daily": 0.0, "Baja kit": 22.5, "rock": 480.0, "baja_prerunner": 550.75}
BY_YEAR = {"2020": 515.0, "2022": 230.25, "2023": 343.0}
BY_MONTH = {"10": 140.0, "2": 212.75, "Jan": 735.5}
GROWTH = [
    ("Baja kit", 2020, 10.0, None), ("Baja kit", 2022, 0.0, -100.0), ("Baja kit", 2023, 12.5, None),
    ("baja_prerunner", 2020, 100.0, None), ("baja_prerunner", 2022, 200.25, 100.2), ("baja_prerunner", 2023, 250.5, 25.1),
    ("daily", 2020, 0.0, None), ("daily", 2022, 0.0, None), ("daily", 2023, 0.0, None),
    ("rock", 2020, 400.0, None), ("rock", 2022, 0.0, -100.0), ("rock", 2023, 80.0, None),
]
SEGMENT = {("segment", "2020"): 100.0, ("segment", "2022"): 200.25, ("segment", "2023"): 250.5}
REST = {("rest", "2020"): 415.0, ("rest", "2022"): 30.0, ("rest", "2023"): 92.5}
SHARES = {"west": "72.9", "south": "27.1", "north": "0.0"}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(7).cache()


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_by_dimension_is_sorted_and_drops_null_keys(table):
    assert pairs(revenue.revenue_by_dimension(table, "region")) == list(BY_REGION.items())


@pytest.mark.parametrize(("period", "expected"), [("year", BY_YEAR), ("month", BY_MONTH)])
def test_trend(table, period, expected):
    assert pairs(revenue.revenue_trend(table, period)) == list(expected.items())


def test_only_known_periods(table):
    assert revenue.revenue_trend(table, "region").count() == 0
    assert revenue.revenue_trend(table, "quarter").count() == 0


def test_top_performers_ties_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([(10, 5.0), (9, 5.0), (2, 1.0), (11, 5.0), (3, None)], "k int, total_revenue double")
    assert pairs(revenue.top_performers(df, "k", 2)) == [("9", 5.0), ("10", 5.0)]
    assert [k for k, _ in pairs(revenue.top_performers(df, "k"))] == ["9", "10", "11", "2", "3"]


def test_growth_fills_gaps_and_uses_the_previous_year_of_the_data(table):
    assert sorted(pairs(revenue.growth_rates(table, "build_category"))) == sorted(GROWTH)


def test_missing_columns_give_empty_tables(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for result in (
        revenue.revenue_by_dimension(df, "region"), revenue.revenue_trend(df), revenue.top_performers(df, "a"),
        revenue.growth_rates(df, "a"), chart_data.year_series(df), chart_data.category_series(df),
        chart_data.segment_vs_rest(df), chart_data.region_share(df), chart_data.chart_data(df),
    ):
        assert result.collect() == []


def test_revenue_must_be_a_number(spark):
    with pytest.raises(DataIngestionError):
        revenue.revenue_by_dimension(spark.createDataFrame([("a", "1")], "k string, total_revenue string"), "k")


@pytest.mark.parametrize("kind", ["decimal(12,2)", "bigint", "float"])
def test_other_number_types(spark, kind):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, v int").select("k", F.col("v").cast(kind).alias("total_revenue"))
    assert pairs(revenue.revenue_by_dimension(df, "k")) == [("a", 3.0), ("b", 0.0)]


def test_sums_do_not_depend_on_order_and_keep_extreme_values(spark):
    values = [0.1] * 10 + [1e25, float("inf"), float("nan")]
    df = spark.createDataFrame([("k", v) for v in values[:10]] + [("big", values[10]), ("inf", values[11]), ("nan", values[12])], "k string, total_revenue double")
    assert dict(pairs(revenue.revenue_by_dimension(df, "k"))) == {"k": 1.0, "big": 1e25, "inf": float("inf"), "nan": 0.0}


def test_keys_are_spelled_as_in_python(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0)], "k boolean, total_revenue double")
    assert [k for k, _ in pairs(revenue.revenue_by_dimension(df, "k"))] == ["False", "True"]


def test_category_series_is_ascending_with_highlights(table):
    assert pairs(chart_data.category_series(table)) == [(k, v, "aja" in k) for k, v in BY_CATEGORY.items()]


def test_segment_vs_rest_puts_null_categories_in_the_rest(table):
    assert {(s, y): v for s, y, v in pairs(chart_data.segment_vs_rest(table))} == {**SEGMENT, **REST}


def test_region_share(table):
    found = {region: (value, f"{share:.1f}") for region, value, share in pairs(chart_data.region_share(table))}
    assert found == {region: (BY_REGION[region], share) for region, share in SHARES.items()}


def test_share_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", None)], "region string, total_revenue double")
    assert [r.share_pct for r in chart_data.region_share(df).collect()] == [None, None]


def test_chart_data_bundles_the_series(table):
    df = table
    found = {(c, s, x): y for c, s, x, y in pairs(chart_data.chart_data(df))}
    expected = {("revenue_by_year", "revenue", k): v for k, v in pairs(chart_data.year_series(df))}
    expected |= {("revenue_by_build_category", "revenue", k): v for k, v, _ in pairs(chart_data.category_series(df))}
    expected |= {("baja_growth_trend", s, k): v for s, k, v in pairs(chart_data.segment_vs_rest(df))}
    expected |= {("revenue_by_region", "revenue", k): v for k, v, _ in pairs(chart_data.region_share(df))}
    assert found == expected


def test_chart_data_without_a_region(table):
    charts = {r.chart for r in chart_data.chart_data(table.drop("region")).collect()}
    assert charts == {"revenue_by_year", "revenue_by_build_category", "baja_growth_trend"}


def test_currency_labels(spark):
    values = [0.0, 499.0, 500.0, 1500.0, 2500.0, 999_999.0, 1e6, 1_250_000.0, 1_350_000.0, -400.0, 12_345_678.9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", currency_label(F.col("v")).alias("label")).collect():
        assert row.label == (f"${row.v / 1_000_000:.1f}M" if row.v >= 1_000_000 else f"${row.v / 1_000:.0f}K")

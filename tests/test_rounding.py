"""Rounding against Python and numpy on many values, ties and near ties among them."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from insightspark.functions.numbers import clamp, numpy_round, percent, python_round

AMOUNT = st.floats(min_value=-1e9, max_value=1e9, allow_nan=False)
NEAR_TIE = st.integers(-10**8, 10**8).map(lambda i: i / 1000)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(AMOUNT, NEAR_TIE), min_size=400, max_size=800))
def test_rounding(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    x = F.col("x")
    rounded = df.select(
        "x", *[python_round(x, d).alias(f"p{d}") for d in (1, 2, 4)], *[numpy_round(x, d).alias(f"n{d}") for d in (1, 2)]
    )
    for row in rounded.collect():
        assert [row[f"p{d}"] for d in (1, 2, 4)] == [round(row.x, d) for d in (1, 2, 4)], row.x
        assert [row[f"n{d}"] for d in (1, 2)] == [float(np.round(row.x, d)) for d in (1, 2)], row.x


def test_nulls_and_zero_totals(spark):
    df = spark.createDataFrame([(None, 0), (5, 0), (150, 3), (-1, 2)], "a int, b int")
    found = df.select(clamp(F.col("a"), 0, 100), percent(F.col("a"), F.col("b")), python_round(F.col("a") / 1.0, 1)).collect()
    assert [r[0] for r in found] == [0, 5, 100, 0]
    assert [r[1] for r in found] == [None, None, 5000.0, -50.0]
    assert found[0][2] is None

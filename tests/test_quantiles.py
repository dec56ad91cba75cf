"""Exact quantiles of hard distributions, and the size of what is counted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from insightspark.operators import quantiles


def hard_columns():
    rng = np.random.default_rng(11)
    n = 20_000
    yield "lognormal", np.exp(8 * rng.normal(size=n))
    yield "power", 1 / rng.random(n) ** 8
    yield "both signs", rng.normal(size=n) * np.exp(30 * rng.normal(size=n))
    yield "one hot value", np.where(rng.random(n) < 0.4, 5.0, rng.random(n))
    yield "infinities", np.where(rng.random(n) < 0.3, -np.inf, np.where(rng.random(n) < 0.3, np.inf, rng.normal(size=n)))
    yield "close together", 1e15 + rng.integers(0, 30_000, n) * 0.125
    yield "zeros", np.where(rng.random(n) < 0.6, 0.0, rng.random(n) * 1e-310)
    yield "few", np.array([3.0, -0.0, 0.0])
    yield "extremes", np.array([np.finfo(float).max, -np.finfo(float).max, 5e-324, -5e-324] * 2000)


def expected(values, p):
    """Numpy's answer, but for ranks that both fall on one infinity."""
    place = (len(values) - 1) * p
    low, high = np.sort(values)[[int(np.floor(place)), int(np.ceil(place))]]
    return float(low if low == high else np.quantile(values, p))


@pytest.mark.parametrize(("name", "values"), list(hard_columns()), ids=lambda x: x if isinstance(x, str) else "")
def test_quantiles_equal_numpy(spark, monkeypatch, name, values):
    monkeypatch.setattr(quantiles, "_FEW", 50)
    rounds, narrowed = [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda v, b: rounds.append(b) or narrowed(v, b))
    probabilities = [0.25, 0.5, 0.75, 0.999]
    cells = spark.createDataFrame([(float(v),) for v in values], "`0` double").repartition(4)
    found = quantiles.quantiles(cells, {0: (len(values), float(values.min()), float(values.max()))}, probabilities)[0]
    assert found == [expected(values, p) for p in probabilities]
    assert len(rounds) <= 10
    # What is left to be counted one by one is bounded by ``_FEW``.
    assert all(b.n <= 50 or b.cut != quantiles._BY_VALUE for bs in rounds for b in bs)


def test_counters_are_bounded(spark):
    values = np.exp(8 * np.random.default_rng(3).normal(size=30_000))
    frame = quantiles.stacked(spark.createDataFrame([(float(v),) for v in values], "`0` double"))
    bracket = quantiles.Bracket(0, float(values.min()), float(values.max()), len(values), 0, [7_500, 15_000])
    while bracket.n > 1:
        found = quantiles._narrowed(frame, [bracket])
        assert len(found) <= 2 and sum(b.n for b in found) < bracket.n
        bracket = max(found, key=lambda b: b.n)
    assert frame.filter(F.col("value").between(bracket.low, bracket.high)).count() == bracket.n

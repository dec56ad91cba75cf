"""Exact order statistics of many columns without sorting or collecting a column.

Each column's value range is narrowed by counting.  A round counts the values
of every bracket in buckets and keeps only the buckets that hold a wanted rank.
Buckets are even; where that has hardly helped, brackets over zero or infinity
are split by sign, wide ones by magnitude and narrow ones evenly again.  So any
column of doubles is down to single values after ten rounds at the latest,
however it is distributed.  Brackets of at most
``_FEW`` values are counted value by value.  A round is one scan and one aggregation of
columns x ranks x buckets rows, whatever the number of rows; a value
shared by a third of the rows is one counter.  Only the brackets, a few per
column, pass through the driver.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKETS = 1024
_FEW = 16_384
# A round that leaves more than this share of the values has hardly helped.
_POOR = 0.25
# How a bracket is cut into buckets.
_BY_SIGN, _BY_MAGNITUDE, _EVENLY, _BY_VALUE = range(4)


class Bracket(NamedTuple):
    """A value range of one column that holds wanted ranks; ``below`` values are smaller."""

    position: int
    low: float
    high: float
    n: int
    below: int
    ranks: list[int]
    skewed: bool = False

    @property
    def cut(self) -> int:
        if self.n <= _FEW:
            return _BY_VALUE
        if not self.skewed and math.isfinite(self.high - self.low):
            return _EVENLY
        if self.low <= 0.0 <= self.high or math.isinf(self.low) or math.isinf(self.high):
            return _BY_SIGN
        small, large = sorted((abs(self.low), abs(self.high)))
        return _BY_MAGNITUDE if large / 8 > small else _EVENLY


_SCHEMA = "bracket int, cut int, position int, low double, high double, n bigint, below bigint, ranks array<bigint>, skewed boolean"


def stacked(cells: DataFrame, positions: list[int] | None = None) -> DataFrame:
    """(position, value) from a table whose columns are named by their position."""
    names = cells.columns if positions is None else [str(p) for p in positions]
    rows = cells.select(*names).unpivot([], names, "position", "value")
    return rows.withColumn("position", F.col("position").cast("int"))


def quantiles(
    cells: DataFrame, bounds: dict[int, tuple[int, float, float]], probabilities: list[float]
) -> dict[int, list[float]]:
    """Per column position the quantiles, interpolated linearly between ranks.

    ``cells`` has DOUBLE columns named by position; ``bounds`` gives the number
    of values that are not null, the smallest and the largest for every column
    with any.  A column is no longer scanned once its ranks are settled.
    """
    brackets = []
    for position, (n, low, high) in bounds.items():
        places = [(n - 1) * p for p in probabilities]
        ranks = sorted({rank for place in places for rank in (math.floor(place), math.ceil(place))})
        brackets.append(Bracket(position, low, high, n, 0, ranks))
    at: dict[tuple[int, int], float] = {}
    while True:
        at.update({(b.position, rank): b.low for b in brackets if b.low == b.high for rank in b.ranks})
        brackets = [b for b in brackets if b.low < b.high]
        if not brackets:
            break
        brackets = _narrowed(stacked(cells, sorted({b.position for b in brackets})), brackets)
    return {
        position: [_interpolated(at, position, (n - 1) * p) for p in probabilities] for position, (n, _, _) in bounds.items()
    }


def _interpolated(at: dict[tuple[int, int], float], position: int, place: float) -> float:
    lower, upper = at[position, math.floor(place)], at[position, math.ceil(place)]
    share = place - math.floor(place)
    if lower == upper:
        return lower
    if share >= 0.5:
        return upper - (upper - lower) * (1.0 - share)
    return lower + (upper - lower) * share


def _narrowed(values: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """The buckets of these brackets that hold a wanted rank, as brackets."""
    rows = [(i, bracket.cut, *bracket) for i, bracket in enumerate(brackets)]
    known = values.sparkSession.createDataFrame(rows, _SCHEMA)
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    magnitude = (F.log2(F.abs(value)) - F.log2(F.abs(low))) / (F.log2(F.abs(high)) - F.log2(F.abs(low)))
    share = F.when(F.col("cut") == _BY_MAGNITUDE, magnitude).otherwise((value - low) / (high - low))
    sign = F.signum(value) + F.when(F.abs(value) == float("inf"), F.signum(value)).otherwise(0.0)
    counter = (
        F.when(F.col("cut") == _BY_VALUE, value + 0.0)
        .when(F.col("cut") == _BY_SIGN, sign)
        .otherwise(F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (_BUCKETS - 1)).cast("double"))
    )
    # At most two brackets per probability and column, and no two of a column overlap.
    inside = values.join(F.broadcast(known.drop("n", "below", "ranks", "skewed")), "position").where(value.between(low, high))
    counted = inside.groupBy("bracket", counter.alias("counter")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    # Every bracket has a bounded number of counters: buckets, or few values.
    so_far = Window.partitionBy("bracket").orderBy("counter").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("n").over(so_far))
    named = placed.join(F.broadcast(known.select("bracket", "position", "below", "ranks")), "bracket")
    start, end = F.col("below") + F.col("upto") - F.col("n"), F.col("below") + F.col("upto")
    held = F.filter("ranks", lambda rank: (rank >= start) & (rank < end))
    found = named.select("bracket", "position", "low", "high", "n", start.alias("start"), held.alias("held")).where(F.size("held") > 0)
    # Once skewed, a bracket and what comes of it stay so.
    return [
        Bracket(*row, skewed=brackets[i].skewed or row[3] > _POOR * brackets[i].n) for i, *row in found.collect()
    ]

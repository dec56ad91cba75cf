"""All revenue aggregates of a table from one scan, by grouping sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.functions.kinds import key_text, present
from insightspark.functions.numbers import numpy_round
from insightspark.operators import chart_data, revenue
from insightspark.operators.revenue import REVENUE, merged_sums, partial_sums, total
from insightspark.session import empty, write_once


class RevenueSets:
    """Sums by every key alone and by the given pairs, written once.

    A task combines its rows per set before the shuffle, so that carries sums only.  Each answer
    equals that of its own operator in ``revenue`` or ``chart_data`` and reads only the written sums;
    one whose columns are absent is empty.
    """

    def __init__(self, df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], revenue_column: str = REVENUE):
        self.spark = df.sparkSession
        self.keys = [k for k in keys if k in df.columns] if revenue_column in df.columns else []
        self.kind = {k: df.schema[k].dataType for k in self.keys}
        if not self.keys:
            return
        sets = [(k,) for k in self.keys] + [p for p in pairs if set(p) <= set(self.keys)]
        values = df.select(*[present(k, self.kind[k]).alias(k) for k in self.keys], F.col(revenue_column))
        sums = values.groupingSets(sets, *self.keys).agg(F.grouping_id().alias("left_out"), *partial_sums(values, revenue_column))
        self.sums = write_once(sums, "revenue-sums")

    def _at(self, *names: str) -> DataFrame:
        """The sums of one grouping set; each key left out is a bit, the last one the lowest."""
        left_out = sum(1 << (len(self.keys) - 1 - i) for i, k in enumerate(self.keys) if k not in names)
        return self.sums.where(F.col("left_out") == left_out)

    def _by(self, name: str) -> DataFrame:
        return self._at(name).where(F.col(name).isNotNull()).select(F.col(name).alias("key"), "exact", "wild")

    def by_dimension(self, name: str) -> DataFrame:
        """As ``revenue_by_dimension``."""
        return self._keyed(name, lambda sums: sums.orderBy(total().desc(), F.col("key").asc()))

    def trend(self, name: str) -> DataFrame:
        """As ``revenue_trend``."""
        return self._keyed(name, lambda sums: sums.orderBy("key"))

    def top(self, name: str, n: int = 5) -> DataFrame:
        """As ``top_performers``."""
        return self._keyed(name, lambda sums: sums.orderBy(total().desc(), F.col("key").asc()).limit(n))

    def _keyed(self, name: str, ordered) -> DataFrame:
        if name not in self.keys:
            return empty(self.spark, "key string, revenue double")
        return revenue.keyed(ordered(self._by(name)), self.kind[name])

    def growth(self, group: str, year: str) -> DataFrame:
        """As ``growth_rates``; the pair must be among the sets."""
        if not {group, year} <= set(self.keys):
            return empty(self.spark, "group string, year int, revenue double, yoy_pct double")
        sums = self._at(group, year).where(F.col(group).isNotNull() & F.col(year).isNotNull())
        rounded = sums.select(F.col(group).alias("key"), F.col(year).alias("period"), numpy_round(total(), 2).alias("revenue"))
        return revenue.growth_of_sums(rounded, self.kind[group])

    def charts(self, category: str, region: str, year: str, segment: str = chart_data.SEGMENT) -> DataFrame:
        """As ``chart_data``; the pair of category and year must be among the sets."""

        def points(chart: str, x: str, series: Column, sums: DataFrame) -> DataFrame:
            return sums.select(F.lit(chart).alias("chart"), series.alias("series"), key_text(F.col("key"), self.kind[x]).alias("x"), total().alias("y"))

        single = ((chart_data.BY_YEAR, year), (chart_data.BY_CATEGORY, category), (chart_data.BY_REGION, region))
        found = [points(chart, x, F.lit("revenue"), self._by(x)) for chart, x in single if x in self.keys]
        if {category, year} <= set(self.keys):
            series = chart_data.series_of(F.col(category), segment).alias("series")
            sums = self._at(category, year).where(F.col(year).isNotNull()).groupBy(series, F.col(year).alias("key")).agg(*merged_sums())
            found.append(points(chart_data.BY_SEGMENT, year, F.col("series"), sums))
        return reduce(DataFrame.unionAll, found, empty(self.spark, "chart string, series string, x string, y double"))

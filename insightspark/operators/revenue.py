"""Revenue by dimension, period, top performers and year-on-year growth.

Column names are parameters.  An operator whose required columns are absent
returns an empty table of the right shape without running a job.  Null keys
are dropped, and a key with only null revenue counts as 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.errors import DataIngestionError
from insightspark.functions.kinds import column, key_text, present
from insightspark.functions.numbers import numpy_round
from insightspark.session import empty

REVENUE = "total_revenue"
YEAR = "year"
PERIODS = ("year", "quarter", "month")

# Sums of doubles depend on the order of the rows, so doubles are summed as
# decimals of this type; values outside its range are summed apart.
_EXACT = T.DecimalType(28, 8)


def partial_sums(df: DataFrame, revenue: str = REVENUE) -> list[Column]:
    """Aggregates ``exact`` and ``wild`` that together hold the revenue sum."""
    kind = df.schema[revenue].dataType
    if not isinstance(kind, T.NumericType):
        raise DataIngestionError(f"Column {revenue} is not numeric: {kind.simpleString()}")
    value = present(revenue, kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        exact = value.try_cast(_EXACT)
        return [F.sum(exact).alias("exact"), F.sum(F.when(exact.isNull(), value.cast("double"))).alias("wild")]
    if isinstance(kind, T.IntegralType):
        value = value.cast("decimal(20,0)")
    return [F.sum(value).alias("exact"), F.lit(None).cast("double").alias("wild")]


def merged_sums() -> list[Column]:
    """The same pair again, from rows that hold partial sums."""
    return [F.sum("exact").alias("exact"), F.sum("wild").alias("wild")]


def total() -> Column:
    """The revenue as double, from a row holding ``exact`` and ``wild``."""
    return F.coalesce(F.col("exact").cast("double"), F.lit(0.0)) + F.coalesce(F.col("wild"), F.lit(0.0))


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def sum_by(df: DataFrame, key: str, revenue: str = REVENUE) -> DataFrame:
    """(key, exact, wild) with the key in its own type and null keys dropped."""
    value = present(key, df.schema[key].dataType)
    return df.where(value.isNotNull()).groupBy(value.alias("key")).agg(*partial_sums(df, revenue))


def revenue_by_dimension(df: DataFrame, dimension: str, revenue: str = REVENUE, ordered: bool = True) -> DataFrame:
    """(key, revenue), largest first, equal sums by key."""
    if not has_columns(df, dimension, revenue):
        return empty(df.sparkSession, "key string, revenue double")
    sums = sum_by(df, dimension, revenue)
    if ordered:
        sums = sums.orderBy(total().desc(), F.col("key").asc())
    return keyed(sums, df.schema[dimension].dataType)


def revenue_trend(df: DataFrame, period: str = YEAR, revenue: str = REVENUE, ordered: bool = True) -> DataFrame:
    """(key, revenue) per year, quarter or month, in the order of the key's own type."""
    if period not in PERIODS or not has_columns(df, period, revenue):
        return empty(df.sparkSession, "key string, revenue double")
    sums = sum_by(df, period, revenue)
    if ordered:
        sums = sums.orderBy("key")
    return keyed(sums, df.schema[period].dataType)


def top_performers(df: DataFrame, dimension: str, n: int = 5, revenue: str = REVENUE) -> DataFrame:
    """The ``n`` keys with the largest sums; equal sums go to the smaller key."""
    if not has_columns(df, dimension, revenue):
        return empty(df.sparkSession, "key string, revenue double")
    best = sum_by(df, dimension, revenue).orderBy(total().desc(), F.col("key").asc()).limit(n)
    return keyed(best, df.schema[dimension].dataType)


def growth_rates(df: DataFrame, group: str, year: str = YEAR, revenue: str = REVENUE) -> DataFrame:
    """(group, year, revenue, yoy_pct) for every group in every year of the data.

    A year missing for a group counts as 0.0.  The previous year is the one
    before it anywhere in the data, and a percentage is given only where that
    year's revenue is positive.

    The years come from a scalar subquery over the same aggregate, whose
    shuffle is reused.  Each group then holds one small map of its years, so
    filling gaps and looking back need neither a join nor a window.
    """
    if not has_columns(df, group, year, revenue):
        return empty(df.sparkSession, "group string, year int, revenue double, yoy_pct double")
    group_kind, year_kind = df.schema[group].dataType, df.schema[year].dataType
    key, period = present(group, group_kind), present(year, year_kind)
    sums = (
        df.where(key.isNotNull() & period.isNotNull())
        .groupBy(key.alias("key"), period.alias("period"))
        .agg(*partial_sums(df, revenue))
        .select("key", "period", numpy_round(total(), 2).alias("revenue"))
    )
    return growth_of_sums(sums, group_kind)


def growth_of_sums(sums: DataFrame, group_kind: T.DataType) -> DataFrame:
    """``growth_rates`` from the rounded sums (key, period, revenue)."""
    # The largest revenue is asked for too, only to keep this aggregate the same
    # as the main one down to its shuffle, so that the input is read once.
    bounds = sums.agg(F.struct(F.array_sort(F.collect_set("period")).alias("years"), F.max("revenue").alias("top")))
    years = bounds.scalar()["years"]
    per_group = (
        sums.groupBy("key")
        .agg(F.map_from_entries(F.collect_list(F.struct("period", "revenue"))).alias("by_year"))
        .withColumn("years", years)
    )

    def in_year(when: Column) -> Column:
        return F.coalesce(F.element_at("by_year", when), F.lit(0.0))

    def line(when: Column, position: Column) -> Column:
        before = F.when(position > 0, in_year(F.get(F.col("years"), position - 1)))
        return F.struct(when.alias("year"), in_year(when).alias("revenue"), before.alias("before"))

    lines = per_group.select("key", F.inline(F.transform("years", line)))
    change = (F.col("revenue") - F.col("before")) / F.col("before") * 100.0
    return lines.select(
        key_text(F.col("key"), group_kind).alias("group"),
        "year",
        "revenue",
        F.when(F.col("before") > 0, numpy_round(change, 1)).alias("yoy_pct"),
    )


def keyed(sums: DataFrame, kind: T.DataType) -> DataFrame:
    """(key, revenue) as texts and rounded sums, from (key, exact, wild)."""
    return sums.select(key_text(F.col("key"), kind).alias("key"), numpy_round(total(), 2).alias("revenue"))

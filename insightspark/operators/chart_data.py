"""The data behind the four standard charts, and their axis labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.functions.kinds import column, key_text, present
from insightspark.functions.numbers import currency_label, percent, python_round
from insightspark.operators.revenue import REVENUE, YEAR, has_columns, merged_sums, partial_sums, sum_by, total
from insightspark.session import empty

CATEGORY = "build_category"
REGION = "region"
# The segment the charts single out, and the text that marks it.
SEGMENT = "baja_prerunner"
HIGHLIGHT = "baja"

# The names of the four charts.
BY_YEAR, BY_CATEGORY, BY_SEGMENT, BY_REGION = (
    "revenue_by_year", "revenue_by_build_category", "baja_growth_trend", "revenue_by_region",
)

_CHART_SCHEMA = "chart string, series string, x string, y double"


def year_series(df: DataFrame, year: str = YEAR, revenue: str = REVENUE) -> DataFrame:
    """(year, revenue), unrounded, in the order of the years."""
    if not has_columns(df, year, revenue):
        return empty(df.sparkSession, "year string, revenue double")
    sums = sum_by(df, year, revenue).orderBy("key")
    return sums.select(key_text(F.col("key"), df.schema[year].dataType).alias("year"), total().alias("revenue"))


def category_series(df: DataFrame, category: str = CATEGORY, revenue: str = REVENUE, highlight: str = HIGHLIGHT) -> DataFrame:
    """(category, revenue, highlighted), smallest first, unrounded."""
    if not has_columns(df, category, revenue):
        return empty(df.sparkSession, "category string, revenue double, highlighted boolean")
    sums = sum_by(df, category, revenue).orderBy(total().asc(), F.col("key").asc())
    name = key_text(F.col("key"), df.schema[category].dataType)
    marked = F.contains(F.lower(name), F.lit(highlight))
    return sums.select(name.alias("category"), total().alias("revenue"), marked.alias("highlighted"))


def segment_vs_rest(
    df: DataFrame, segment: str = SEGMENT, category: str = CATEGORY, year: str = YEAR, revenue: str = REVENUE
) -> DataFrame:
    """(series, year, revenue): the segment and everything else, null categories included there."""
    if not has_columns(df, category, year, revenue):
        return empty(df.sparkSession, "series string, year string, revenue double")
    kind = df.schema[year].dataType
    key = present(year, kind)
    series = series_of(column(category), segment)
    sums = df.where(key.isNotNull()).groupBy(series.alias("series"), key.alias("key")).agg(*partial_sums(df, revenue))
    return sums.orderBy("series", "key").select("series", key_text(F.col("key"), kind).alias("year"), total().alias("revenue"))


def region_share(df: DataFrame, region: str = REGION, revenue: str = REVENUE) -> DataFrame:
    """(region, revenue, share_pct) with one decimal, largest first; null share of a zero total."""
    if not has_columns(df, region, revenue):
        return empty(df.sparkSession, "region string, revenue double, share_pct double")
    sums = sum_by(df, region, revenue)
    # Added up as decimals, so that the total does not depend on the order of rows.
    # The key is asked for only to keep this aggregate, and its shuffle, the same.
    whole = sums.agg(*merged_sums(), F.max("key").alias("key")).select(F.struct(total().alias("revenue"), "key")).scalar()
    shares = sums.withColumn("share", percent(total(), whole["revenue"]))
    return shares.orderBy(total().desc(), F.col("key").asc()).select(
        key_text(F.col("key"), df.schema[region].dataType).alias("region"),
        total().alias("revenue"),
        python_round(F.col("share"), 1).alias("share_pct"),
    )


def with_currency_label(df: DataFrame, value: str, label: str = "label") -> DataFrame:
    """Add the axis label of a money column."""
    return df.withColumn(label, currency_label(column(value).cast("double")))


def chart_data(
    df: DataFrame,
    segment: str = SEGMENT,
    category: str = CATEGORY,
    region: str = REGION,
    year: str = YEAR,
    revenue: str = REVENUE,
) -> DataFrame:
    """(chart, series, x, y) of all four charts; a chart without its columns has no rows.

    The table is aggregated once to (year, category, region).  Each of those
    few rows then goes to every chart it belongs to and is summed again.
    """
    keys = [name for name in (year, category, region) if name in df.columns]
    if revenue not in df.columns or not keys:
        return empty(df.sparkSession, _CHART_SCHEMA)
    kind = {name: df.schema[name].dataType for name in keys}
    base = df.groupBy(*[present(n, kind[n]).alias(n) for n in keys]).agg(*partial_sums(df, revenue))

    def point(chart: str, x: str, series: Column) -> Column:
        text = key_text(column(x), kind[x]).alias("x")
        return F.struct(F.lit(chart).alias("chart"), series.alias("series"), text, "exact", "wild")

    points = []
    if year in keys:
        points.append(point(BY_YEAR, year, F.lit("revenue")))
    if category in keys:
        points.append(point(BY_CATEGORY, category, F.lit("revenue")))
    if category in keys and year in keys:
        points.append(point(BY_SEGMENT, year, series_of(column(category), segment)))
    if region in keys:
        points.append(point(BY_REGION, region, F.lit("revenue")))
    stacked = base.select(F.inline(F.array(*points))).where(F.col("x").isNotNull())
    return stacked.groupBy("chart", "series", "x").agg(*merged_sums()).select("chart", "series", "x", total().alias("y"))


def series_of(category: Column, segment: str) -> Column:
    return F.when(category.eqNullSafe(F.lit(segment)), "segment").otherwise("rest")

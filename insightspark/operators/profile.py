"""Table profile: shape, columns, numeric summary, top values, dates, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.functions import kinds
from insightspark.functions.kinds import column, present
from insightspark.functions.numbers import numpy_round, percent, python_round
from insightspark.operators.quantiles import quantiles, stacked
from insightspark.session import empty, write_once

PROBABILITIES = [0.25, 0.5, 0.75]
# Characters of a text that are counted along with its hash, to order equal counts.
_PREFIX = 16

_SUMMARY = (
    "column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
)


def shape(df: DataFrame) -> DataFrame:
    """One row: ``rows``, ``columns``."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, value, n): how often each value occurs in each column, nulls too.

    The columns are stacked and counted together: one shuffle, and copies of a
    value collapse before it.  Values are compared as text, with -0.0 as 0.0.
    """
    names = df.columns if columns is None else columns
    cells = df.select(*[_as_text(n, df.schema[n].dataType).alias(str(df.columns.index(n))) for n in names])
    cell_rows = cells.unpivot([], cells.columns, "position", "value")
    return cell_rows.groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, approximate: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """(column, position, dtype, null_count, null_pct, unique_count), nulls not counted as values.

    Values are told apart by 128 bits of hashes, so what is shuffled has a
    fixed size however long the texts are.  ``approximate`` replaces the distinct
    counts by sketches: one scan and one shuffled row per task.  ``counts`` may
    be a written ``value_counts`` or ``hashed_counts``.
    """
    if approximate:
        per_column = _sketched_columns(df)
    else:
        found = hashed_counts(df) if counts is None else counts
        per_column = found.groupBy("position").agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
            F.count("value").alias("unique_count"),
        )
    null_pct = python_round(percent(F.col("null_count"), F.col("rows")), 2)
    return per_column.select(
        _lookup(df, lambda f: f.name).alias("column"),
        F.col("position").cast("int").alias("position"),
        _lookup(df, lambda f: kinds.dtype_name(f.dataType)).alias("dtype"),
        F.col("null_count").cast("bigint").alias("null_count"),
        null_pct.alias("null_pct"),
        F.col("unique_count").cast("bigint").alias("unique_count"),
    )


def numeric_summary(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max), two decimals, per numeric column.

    The quantiles are exact and are found here and now: a scan for the bounds and
    usually two more, over the columns that are not settled yet;
    ``approximate`` takes them from sketches, in one scan.
    """
    names = kinds.numeric_columns(df) if columns is None else columns
    if not names:
        return empty(df.sparkSession, _SUMMARY)
    cells = df.select(*[present(n, df.schema[n].dataType).cast("double").alias(str(i)) for i, n in enumerate(names)])
    value = F.col("value")
    measures = [F.count(value), F.avg(value), F.stddev_samp(value), F.min(value), F.max(value)]
    if approximate:
        measures.append(F.percentile_approx(value, PROBABILITIES, 10_000))
    found = {position: row for position, *row in stacked(cells).groupBy("position").agg(*measures).collect()}
    if approximate:
        at = {position: row[5] for position, row in found.items() if row[0]}
    else:
        at = quantiles(cells, {position: (row[0], row[3], row[4]) for position, row in found.items() if row[0]}, PROBABILITIES)
    rows = []
    for position, (count, mean, std, low, high, *_) in sorted(found.items()):
        rows.append((names[position], count, mean, std, low, *at.get(position, [None] * 3), high))
    summary = df.sparkSession.createDataFrame(rows, _SUMMARY)
    return summary.select("column", "count", *[numpy_round(F.col(c), 2).alias(c) for c in summary.columns[2:]])


def top_values(df: DataFrame, n: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """(column, rank, value, n): the most frequent values of each text column.

    Equal counts are ordered by value.  Values are counted by their hashes, as
    ``hashed_counts`` gives them; only the texts of candidates are fetched, so what
    is shuffled does not grow with the texts.  The rank filter prunes each task's rows
    before they are shuffled.  ``counts`` may be a written ``hashed_counts`` or ``value_counts``.
    """
    names = kinds.text_columns(df)
    if not names:
        return empty(df.sparkSession, "column string, rank int, value string, n bigint")
    found = hashed_counts(df, names) if counts is None else counts
    found = found.where(F.col("position").isin([str(df.columns.index(name)) for name in names]) & F.col("value").isNotNull())
    if isinstance(found.schema["value"].dataType, T.StructType):
        found = _candidate_texts(df, names, found, n)
    best = Window.partitionBy("position").orderBy(F.col("n").desc(), F.col("value").asc())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return ranked.select(_lookup(df, lambda f: f.name).alias("column"), "rank", "value", "n")


def _candidate_texts(df: DataFrame, names: list[str], found: DataFrame, n: int) -> DataFrame:
    """(position, value, n) of the values that can be among the first ``n``, with their texts.

    Beyond the first ``n`` by count and the beginning of the text, only values that tie in both
    are candidates.  They are written, so the join with the table follows from their size.
    """
    first = Window.partitionBy("position").orderBy(F.col("n").desc(), F.col("prefix").asc())
    chosen = found.withColumn("place", F.rank().over(first)).where(F.col("place") <= n)
    chosen = write_once(chosen.select(F.col("position").alias("at"), F.col("value").alias("hash"), "n"), "top-candidates")
    cells = [
        F.struct(F.lit(str(df.columns.index(name))).alias("at"), value_hash(df, name).alias("hash"), column(name).alias("value")) for name in names
    ]
    texts = df.select(F.inline(F.array(*cells))).where(F.col("hash").isNotNull()).join(chosen, ["at", "hash"])
    return texts.groupBy(F.col("at").alias("position"), "hash", "n").agg(F.first("value").alias("value"))


def date_range(df: DataFrame) -> DataFrame:
    """(column, min, max) of each temporal column, as text; "NaT" if it has no value."""
    names = kinds.temporal_columns(df)
    if not names:
        return empty(df.sparkSession, "column string, min string, max string")
    bounds = df.agg(
        *[F.min(column(n)).alias(f"min{i}") for i, n in enumerate(names)],
        *[F.max(column(n)).alias(f"max{i}") for i, n in enumerate(names)],
    )

    def text(name: str) -> Column:
        return F.coalesce(kinds.timestamp_text(F.col(name)), F.lit("NaT"))

    rows = [
        F.struct(F.lit(n).alias("column"), text(f"min{i}").alias("min"), text(f"max{i}").alias("max"))
        for i, n in enumerate(names)
    ]
    return bounds.select(F.inline(F.array(*rows)))


def health_score(df: DataFrame) -> DataFrame:
    """One row: the three partial scores and ``data_health_score`` (0-100, truncated).

    One aggregation by all columns gives the row count, the duplicates and the
    nulls of every column at once.
    """
    names = df.columns
    groups = df.groupBy(*[present(n, df.schema[n].dataType).alias(f"c{i}") for i, n in enumerate(names)]).agg(
        F.count(F.lit(1)).alias("copies")
    )
    missing = [F.sum(F.when(F.col(f"c{i}").isNull(), F.col("copies")).otherwise(0)).alias(f"nulls{i}") for i in range(len(names))]
    totals = groups.agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), *missing)
    rows = F.col("rows")
    null_pcts = [python_round(percent(F.col(f"nulls{i}"), rows), 2).cast("decimal(9,2)") for i in range(len(names))]
    mean_pct = F.aggregate(F.array(*null_pcts), F.lit(0).cast("decimal(20,2)"), lambda a, x: (a + x).cast("decimal(20,2)"))
    completeness = _floor_zero(100.0 - mean_pct.cast("double") / len(names))
    row_score = F.when(rows > 0, F.least(F.lit(100.0), rows.cast("double") / 100.0 * 10.0))
    dup_score = _floor_zero(100.0 - percent(rows - F.col("distinct_rows"), rows) * 2.0)
    scored = totals.select(
        completeness.alias("completeness_score"), row_score.alias("row_score"), dup_score.alias("duplicate_score")
    )
    mean_score = (F.col("completeness_score") + F.col("row_score") + F.col("duplicate_score")) / 3.0
    return scored.withColumn("data_health_score", F.floor(mean_score).cast("int"))


def profile_table(df: DataFrame, approximate: bool = False) -> dict[str, DataFrame]:
    """All profile tables of one input, by name.

    The exact counts of hashed values feed two of them and are written once to the shared
    folder.  Pass a table that is itself written or cheap to rescan.
    """
    counts = None if approximate else write_once(hashed_counts(df), "value-counts")
    return {
        "shape": shape(df),
        "columns": column_profile(df, approximate, counts),
        "numeric_summary": numeric_summary(df, approximate=approximate),
        "categorical_summary": top_values(df, counts=counts),
        "date_range": date_range(df),
        "data_health_score": health_score(df),
    }


def _as_text(name: str, kind: T.DataType) -> Column:
    value = present(name, kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0)
    return value.cast("string")


def value_hash(df: DataFrame, name: str) -> Column:
    """128 bits of hashes of a value, null for missing ones."""
    kind = df.schema[name].dataType
    value = present(name, kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0)
    return F.when(value.isNotNull(), F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b")))


def hashed_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, value, prefix, n) like ``value_counts``, with hashes for values.

    ``prefix`` is the beginning of a text, null for other types.
    """
    texts = set(kinds.text_columns(df))

    def cell(name: str) -> Column:
        prefix = F.substring(column(name), 1, _PREFIX) if name in texts else F.lit(None).cast("string")
        return F.struct(F.lit(str(df.columns.index(name))).alias("position"), value_hash(df, name).alias("value"), prefix.alias("prefix"))

    cells = df.select(F.inline(F.array(*[cell(n) for n in (df.columns if columns is None else columns)])))
    return cells.groupBy("position", "value", "prefix").agg(F.count(F.lit(1)).alias("n"))


def _sketched_columns(df: DataFrame) -> DataFrame:
    measures = []
    for i, name in enumerate(df.columns):
        value = present(name, df.schema[name].dataType)
        measures += [F.count(value).alias(f"filled{i}"), F.approx_count_distinct(value).alias(f"unique{i}")]
    one_row = df.agg(F.count(F.lit(1)).alias("rows"), *measures)
    rows = [
        F.struct(
            F.lit(str(i)).alias("position"),
            F.col("rows"),
            (F.col("rows") - F.col(f"filled{i}")).alias("null_count"),
            F.col(f"unique{i}").alias("unique_count"),
        )
        for i in range(len(df.columns))
    ]
    return one_row.select(F.inline(F.array(*rows)))


def _lookup(df: DataFrame, read) -> Column:
    """A fixed text per column position."""
    return F.element_at(F.array(*[F.lit(read(f)) for f in df.schema]), F.col("position").cast("int") + 1)


def _floor_zero(score: Column) -> Column:
    """Not below zero; stays null for an empty table."""
    return F.when(score < 0, 0.0).otherwise(score)

"""Profiles of tables that grow by loads: a state per load and column, merged without reading older loads.

Rows, nulls, means, deviations and bounds merge exactly; distinct values, quantiles and frequent
values are sketches.  Bounds: distinct counts have a relative standard error of 0.8 %, quantiles a rank
error of about 0.4 %, and frequent values are exact while a column has at most ``TRACKED`` * 0.75 values; beyond
that a value's count is too large by at most a few times rows / ``TRACKED``.

Defined cases: a load written again replaces itself; a column that a load lacks is null in all its
rows; an empty load and a column of nulls have no quantiles; columns of different numeric types are float64,
of other different types object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from insightspark.functions import kinds
from insightspark.functions.kinds import column, present
from insightspark.functions.numbers import numpy_round, percent, python_round
from insightspark.operators.profile import PROBABILITIES, value_hash

HLL_BITS = 14
KLL_SIZE = 800
TRACKED = 1000
_FREQUENT = "struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>"


def load_states(df: DataFrame, load: str) -> DataFrame:
    """One row per column of a load, from one scan and one shuffled row per task."""
    texts, numbers = set(kinds.text_columns(df)), set(kinds.numeric_columns(df))
    measures = []
    for i, name in enumerate(df.columns):
        value = present(name, df.schema[name].dataType)
        measures += [F.count(value).alias(f"filled{i}"), F.hll_sketch_agg(value_hash(df, name)["a"], F.lit(HLL_BITS)).alias(f"distinct{i}")]
        if name in numbers:
            number = value.cast("double")
            measures += [F.avg(number).alias(f"mean{i}"), F.var_pop(number).alias(f"var{i}"), F.min(number).alias(f"low{i}")]
            measures += [F.max(number).alias(f"high{i}"), F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)).alias(f"ranks{i}")]
        if name in texts:
            measures.append(F.call_function("approx_top_k_accumulate", column(name), F.lit(TRACKED)).alias(f"frequent{i}"))
    one_row = df.agg(F.count(F.lit(1)).alias("rows"), *measures)

    def state(i: int, name: str) -> Column:
        def part(field: str, kind: str, there: bool) -> Column:
            return (F.col(f"{field}{i}") if there else F.lit(None)).cast(kind).alias(field)

        number = name in numbers
        filled = F.col(f"filled{i}")
        return F.struct(
            F.lit(name).alias("column"), F.lit(i).alias("position"), F.lit(kinds.dtype_name(df.schema[name].dataType)).alias("dtype"),
            "rows", filled.alias("filled"), F.col(f"distinct{i}").alias("distinct"),
            part("mean", "double", number), part("var", "double", number), part("low", "double", number), part("high", "double", number),
            F.when(filled > 0, F.col(f"ranks{i}") if number else F.lit(None)).cast("binary").alias("ranks"),
            part("frequent", _FREQUENT, name in texts),
        )

    states = one_row.select(F.inline(F.array(*[state(i, n) for i, n in enumerate(df.columns)])))
    return states.withColumn("load", F.lit(load))


def write_states(df: DataFrame, load: str, folder: str) -> None:
    """Keep the state of a load below ``folder``; the same load again takes its own place."""
    rows = load_states(df, load).coalesce(1)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(folder)


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def merged_profile(states: DataFrame) -> DataFrame:
    """(column, position, dtype, null_count, null_pct, unique_count, count, mean, std, min, p25, p50, p75, max) over all loads.

    Rounded as the exact profile is; the last seven are null but for numbers.
    """
    loads = states.groupBy("load").agg(F.max("rows").alias("rows"))
    rows = loads.agg(F.sum("rows").alias("rows")).scalar()
    numbers = F.col("mean").isNotNull()
    means = states.groupBy("column").agg(
        (F.sum(F.when(numbers, F.col("filled") * F.col("mean"))) / F.sum(F.when(numbers, F.col("filled")))).alias("whole_mean")
    )
    apart = F.col("filled") * (F.col("var") + (F.col("mean") - F.col("whole_mean")) * (F.col("mean") - F.col("whole_mean")))
    merged = (
        states.join(means, "column")
        .groupBy("column")
        .agg(
            F.min("position").alias("position"),
            F.array_sort(F.collect_set("dtype")).alias("dtypes"),
            F.sum("filled").alias("filled"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("unique_count"),
            F.max("whole_mean").alias("mean"),
            F.sum(apart).alias("squares"),
            F.min("low").alias("min"),
            F.max("high").alias("max"),
            F.kll_merge_agg_double("ranks").alias("ranks"),
            F.count("ranks").alias("ranked"),
        )
        .withColumn("rows", rows)
    )
    dtype = (
        F.when(F.size("dtypes") == 1, F.get("dtypes", F.lit(0)))
        .when(F.size(F.array_except("dtypes", F.array(F.lit("int64"), F.lit("float64")))) == 0, "float64")
        .otherwise("object")
    )
    number = F.col("ranked") > 0
    quantile = F.when(number, F.kll_sketch_get_quantile_double("ranks", F.array(*[F.lit(p) for p in PROBABILITIES])))
    std = F.when(F.col("filled") > 1, F.sqrt(F.col("squares") / (F.col("filled") - 1)))
    shown = {"mean": F.col("mean"), "std": std, "min": F.col("min")}
    shown |= {f"p{int(p * 100)}": F.get(quantile, F.lit(i)) for i, p in enumerate(PROBABILITIES)} | {"max": F.col("max")}
    return merged.select(
        "column",
        "position",
        dtype.alias("dtype"),
        (F.col("rows") - F.col("filled")).alias("null_count"),
        python_round(percent(F.col("rows") - F.col("filled"), F.col("rows")), 2).alias("null_pct"),
        "unique_count",
        F.when(number, F.col("filled")).alias("count"),
        *[numpy_round(F.when(number, value), 2).alias(name) for name, value in shown.items()],
    )


def merged_top_values(states: DataFrame, n: int = 5) -> DataFrame:
    """(column, rank, value, n): the most frequent values of each text column over all loads, equal counts by value."""
    merged = (
        states.where(F.col("frequent").isNotNull())
        .groupBy("column")
        .agg(F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent"))
    )
    estimate = F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(TRACKED))
    items = merged.select("column", F.inline(estimate)).select("column", F.col("item").alias("value"), F.col("count").alias("n"))
    best = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    known = items.where(F.col("value").isNotNull())
    return known.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("column", "rank", "value", "n")

"""The flat sales table the revenue operators work on, from the star schema."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALES_COLUMNS = (
    "region", "build_category", "vehicle_platform", "customer_segment", "year", "quarter", "month", "total_revenue",
)
_FROM_ORDER = {"year", "quarter", "month"}
_FROM_CUSTOMER = {"region", "customer_segment"}
_FROM_PART = {"build_category", "vehicle_platform"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def sales_view(spark: SparkSession, folder: str, columns: tuple[str, ...] = SALES_COLUMNS) -> DataFrame:
    """One row per line item with the requested attributes.

    Attributes are looked up by left joins on unique keys, so a lookup nobody
    asked for changes no row and is left out of the plan.  Line items are
    shuffled once, by order key.  No join is hinted:
    the small tables are broadcast when their size is below the session's
    limit, and AQE splits skewed keys of the large ones.
    """
    return sales_rows(table(spark, folder, "lineitem"), spark, folder, columns)


def sales_rows(lines: DataFrame, spark: SparkSession, folder: str, columns: tuple[str, ...]) -> DataFrame:
    """``sales_view`` over given line items, which may be a stream."""
    wanted = set(columns)
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    kept_share = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    rows = lines.select("l_orderkey", "l_partkey", (price * kept_share).alias("total_revenue"))
    if wanted & (_FROM_ORDER | _FROM_CUSTOMER):
        rows = rows.join(_order_lookup(spark, folder, wanted), "l_orderkey", "left")
    if wanted & _FROM_PART:
        parts = table(spark, folder, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.col("p_type").alias("build_category"),
            F.col("p_brand").alias("vehicle_platform"),
        )
        rows = rows.join(parts, "l_partkey", "left")
    return rows.select(*columns)


def _order_lookup(spark: SparkSession, folder: str, wanted: set[str]) -> DataFrame:
    """Orders with what is asked for of their customers.

    It is put together before the line items come in, so those are shuffled by
    order key once, and never by customer.
    """
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        "o_custkey",
        F.year("o_orderdate").alias("year"),
        F.quarter("o_orderdate").alias("quarter"),
        F.month("o_orderdate").alias("month"),
    )
    if not wanted & _FROM_CUSTOMER:
        return orders
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.col("c_mktsegment").alias("customer_segment")
    )
    if "region" in wanted:
        nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
        regions = table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
        places = nations.join(regions, "n_regionkey", "left")
        customers = customers.join(places, "c_nationkey", "left")
    return orders.join(customers, "o_custkey", "left")

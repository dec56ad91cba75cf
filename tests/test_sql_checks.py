"""Every registered query against its SQL, with few and with many shuffle partitions."""

import os

import pytest
from compare import connect, differences
from conftest import SMALL

import __spark_entry__ as driver
from insightspark.plans.queries import QUERIES
from insightspark.plans.sql_checks import SQL_CHECKS

CHECKS = driver.oracle_sql()


def test_every_query_has_a_check():
    assert set(QUERIES) == set(SQL_CHECKS)
    assert set(CHECKS) <= set(driver.queries())


@pytest.fixture(scope="module")
def tables():
    return connect(SMALL)


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, tables, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert differences(driver.queries()[name](spark, SMALL), tables, CHECKS[name]) == ""
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.skipif(os.environ.get("FULL") is None, reason="set FULL=1 for the larger scale")
@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql_at_a_larger_scale(spark, name):
    folder = "/root/testdata/sf0.01"
    assert differences(driver.queries()[name](spark, folder), connect(folder), CHECKS[name]) == ""


def test_entry_runs(spark):
    result = driver.entry(spark)
    assert result.columns == ["group", "year", "revenue", "yoy_pct"]
    assert result.count() > 0

"""Queries whose rows take long, on a table that is one small file with one row group."""

import pytest
from pyspark.sql import functions as F

from fieldloom.catalog import inputs as I
from fieldloom.catalog import tables, texts
from fieldloom.operators.flatten import flatten_results


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    found = str(tmp_path_factory.mktemp("one"))
    rows = spark.range(1000).selectExpr(
        "id as c_custkey", "concat('Customer#', id) as c_name", "cast(id % 25 as int) as c_nationkey", "cast(id as double) as c_acctbal", "'BUILDING' as c_mktsegment"
    )
    rows.coalesce(1).write.parquet(f"{found}/customer.parquet")
    return found


def shares(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_results_are_flattened_in_many_tasks(spark, folder):
    records = flatten_results(I.analysis_results(spark, folder))
    assert len(shares(records)) >= 4 and max(shares(records)) < 400
    # Nothing is parsed in the one task that reads the file.
    assert "FileScan" not in records._jdf.queryExecution().toString()


def test_wide_table_is_made_in_many_tasks(spark, folder):
    found = shares(tables.unified_table(spark, folder))
    assert len(found) >= 4 and sum(found) == 900 and max(found) < 400


def test_values_are_cleaned_in_many_tasks(spark, folder):
    found = shares(texts.value_cleaning(spark, folder))
    assert len(found) >= 4 and sum(found) == 1000 and max(found) < 400

"""Run and summary reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import constants as C
from fieldloom.functions import json as J
from fieldloom.functions import text as X


def failed_items(results: DataFrame, error: str = "error") -> DataFrame:
    """Rows with an error."""
    return results.filter(F.col(error).isNotNull())


def successful_items(results: DataFrame, error: str = "error") -> DataFrame:
    """Rows without an error."""
    return results.filter(F.col(error).isNull())


def run_report(results: DataFrame, error: str = "error") -> DataFrame:
    """One row: totals and time. The failed rows are ``failed_items``, a table of any size."""
    return results.agg(
        F.count("*").alias("total_urls"),
        F.count_if(F.col(error).isNull()).alias("successful"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
    ).withColumn("timestamp", X.epoch_seconds())


def run_summary(results: DataFrame, data: str = "data") -> DataFrame:
    """One row: totals by presence of data, and the share of success."""
    good = J.has_data(F.col(data))
    counted = results.agg(
        F.count("*").alias("total_urls"),
        F.count_if(good).alias("successful"),
        F.count_if(~good).alias("failed"),
    )
    rate = F.coalesce(F.try_divide(F.col("successful"), F.col("total_urls")), F.lit(0.0))
    return counted.withColumn("success_rate", rate)


def summary_failures(results: DataFrame, data: str = "data") -> DataFrame:
    """Items without data and the reason, if one is known."""
    return results.filter(~J.has_data(F.col(data))).select(
        "url_id", "url", F.coalesce("error", F.lit(C.UNKNOWN_ERROR)).alias("error")
    )

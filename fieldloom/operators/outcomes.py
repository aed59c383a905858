"""Result records: every outcome is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import constants as C
from fieldloom.functions import json as J
from fieldloom.functions import text as X


def outcome_error(content_length: Column, has_data: Column, error: Column) -> Column:
    """Why an item has no data: no content, its own error, or no reply; null on success."""
    return (
        F.when(F.coalesce(content_length, F.lit(0)) == 0, C.NO_CONTENT)
        .when(error.isNotNull(), error)
        .when(~has_data, C.NO_REPLY)
    )


def result_records(scored: DataFrame) -> DataFrame:
    """``url_key, url, timestamp, content_length, data, error`` from ``content_length``,
    ``parsed_response`` and ``error``; a failure has neither time nor length."""
    error = outcome_error(
        F.col("content_length"), J.has_data(F.col("parsed_response")), F.col("error")
    )
    named = scored.withColumn("error", error)
    good = F.col("error").isNull()
    return named.select(
        "url_key",
        "url",
        F.when(good, X.epoch_seconds()).alias("timestamp"),
        F.when(good, F.col("content_length")).alias("content_length"),
        F.when(good, F.col("parsed_response")).alias("data"),
        "error",
    )

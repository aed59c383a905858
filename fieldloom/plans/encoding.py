"""Repair of CSV files in mixed character sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.session import configure
from fieldloom.sources import readers as R
from fieldloom.sources import writers as W


def repair_csv(
    spark: SparkSession, path: str | list[str], output: str, fallback: str = "windows-1256"
) -> DataFrame:
    """Write each file again as UTF-8 with a byte order mark, in a folder that bears its name.

    Files keep their own headers and values, whatever these hold. Gives all rows of the output,
    with the file's name, a column that a file lacks being null.
    """
    parts = R.read_csv_groups(configure(spark), path, fallback)
    for at, part in enumerate(parts):
        W.write_csv(part, output, by=R.SOURCE_FILE, mode="append" if at else "overwrite")
    folders = f"{output}/{R.SOURCE_FILE}=*"
    return R.read_csv_any_charset(spark, folders) if parts else spark.read.csv(path, header=True)


def head(rows: DataFrame, n: int = 2) -> DataFrame:
    """First rows, to look at."""
    return rows.limit(n)

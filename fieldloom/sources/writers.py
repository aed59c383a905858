"""Sinks: appended stage tables and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"


def append_run(rows: DataFrame, path: str, run_id: str) -> DataFrame:
    """Write the rows of one run to a stage table and read them back.

    Reading back keeps a costly or non-repeatable step from being run again by a later reader.
    """
    folder = f"{path}/run_id={run_id}"
    rows.write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def append_by_task(rows: DataFrame, path: str, run_id: str) -> None:
    """Write a run's rows to a stage table so that every task's rows stay as soon as it ends.

    A task moves its file in place when it commits, under a name that is its own in the job, so a
    task that is run again replaces its file, and a job that is cut short loses only the tasks that
    had not ended. Rows written before stay.
    """
    by_task = rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    by_task.parquet(f"{path}/run_id={run_id}/part=0")


def earlier_runs(spark: SparkSession, path: str, schema: str, run_id: str) -> DataFrame:
    """Rows other runs wrote to a stage table; empty when there are none."""
    expected = T.StructType.fromDDL(f"{schema}, run_id string")
    try:
        rows = spark.read.schema(expected).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], expected)
    return rows.select(*expected.fieldNames()).filter(F.col("run_id") != run_id)


def write_csv(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """CSV with header, each part file in UTF-8 with a byte order mark; a folder per value of ``by``."""
    first = df.columns[0]
    writer = df.withColumnRenamed(first, BOM + first).write.mode(mode)
    if by is not None:
        writer = writer.partitionBy(by)
    writer.csv(
        path,
        header=True,
        encoding="UTF-8",
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_lines(df: DataFrame, path: str) -> None:
    """A single text column, one value per line."""
    df.write.mode("overwrite").text(path)


def write_objects(df: DataFrame, column: str, path: str) -> None:
    """A VARIANT column as one JSON object per line."""
    write_lines(df.select(F.to_json(column).alias("value")), path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet table."""
    df.write.mode("overwrite").parquet(path)

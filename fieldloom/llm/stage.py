"""Shared-folder tables between the jobs of one operator, and small column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space between words: space, and tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
# Spark's setting that deletes the shuffle files of a query as it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"


def written(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: what follows survives lost
    executors without repeating it. The files go when the application ends. With ``release`` the
    shuffle files of its making go at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    target = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    before = spark.conf.get(CLEAN_SHUFFLES)
    if release:
        spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(target)
    finally:
        if release:
            spark.conf.set(CLEAN_SHUFFLES, before)
    files.deleteOnExit(path)
    back = spark.read.schema(df.schema).parquet(target)
    back.stage_folder = target
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stage_folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def parallel(df: DataFrame) -> int:
    """Partitions for a narrow shuffle, as the session is set."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def boxed(df: DataFrame, **taken: str) -> DataFrame:
    """The columns ``taken`` under their new names, and all others as the struct ``_rest``: what an
    operator adds in between meets no name of the caller's."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in taken.values()]
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in taken.items()], F.struct(*(rest or [F.lit(0)])).alias("_rest"))


def opened(columns: list[str], **taken: str) -> list[Column]:
    """The columns of a boxed table under their old names and in their old order."""
    back = {c: n for n, c in taken.items()}
    return [F.col(back[c] if c in back else f"_rest.`{c}`").alias(c) for c in columns]

"""Session settings the library relies on, and the one way it cuts lineage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # A JSON object may repeat a key; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # CSV files come in more character sets than the reader accepts by default.
    "spark.sql.legacy.javaCharsets": "true",
    # Generated methods the JVM would not compile are left to smaller ones instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Pages and replies are long texts, so Arrow batches are bounded by bytes, not by rows alone.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}

# Settings that only change speed and memory, with Spark's defaults.
DEFAULTS = {
    "spark.sql.codegen.hugeMethodLimit": "65535",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}
TUNING = frozenset(DEFAULTS)


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options every job here needs; all are runtime options of the session.

    Batch sizes and the limit of generated methods stay as they are where the caller set them.
    """
    for key, value in SETTINGS.items():
        if key not in TUNING or spark.conf.get(key, None) in (None, DEFAULTS.get(key)):
            spark.conf.set(key, value)
    # The few Python helpers travel with the tasks, so executors need no installed copy.
    package = sys.modules[__package__]
    if package.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)
    return spark


def deal(df: DataFrame) -> DataFrame:
    """Rows in even shares over as many tasks as a shuffle of the session has.

    Files are cut into tasks by bytes, so narrow rows that each take long would be one task.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, spark.sparkContext.defaultParallelism))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder the cluster names and continue from there.

    Without one, checkpoints go beside the warehouse's tables, which all executors reach too.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared)
    return df.checkpoint()

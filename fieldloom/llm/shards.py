"""Shards by jump consistent hashing of a stable key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from fieldloom.llm.stage import boxed, opened

# Multiplier of the 64-bit generator that the published jump hash steps with.
STEP = np.uint64(2862933555777941757)
# Rows that one task numbers at a time, about, in every shard.
ROWS_PER_BLOCK = 250_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key: the last place its seeded walk over growing counts jumps to.

    With one shard more, a key either stays or moves to the new shard.
    """
    state = keys.astype(np.uint64)
    place = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        place[going] = ahead[going]
        state[going] = state[going] * STEP + np.uint64(1)
        drawn = (state[going] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[going] = ((place[going] + 1) * (float(1 << 31) / drawn)).astype(np.int64)
        going = going[ahead[going] < shards]
    return place


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a key of any type, 0 to ``shards`` - 1. A null key counts as one key."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")

    @pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(jump(hashes.to_numpy(np.int64, na_value=0).view(np.uint64), shards).astype("int32"))

    return place(F.xxhash64(key.cast("string")))


def shard(
    docs: DataFrame,
    shards: int = 16,
    key: str = "doc_id",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (the shard when there is one more) and ``slot``.

    ``slot`` numbers the rows of a shard from 0 without gaps. Rows are numbered inside (shard,
    block) groups, where a block is a hash of the key and there are as many as the row count
    asks for, and each group starts where the ones before it end; so no task sorts a whole shard.
    Rows with equal keys, null among them, share a shard and are numbered one after the other.
    The three added columns replace columns of those names; an empty table gives no rows.
    """
    docs = docs.drop("shard", "grown_shard", "slot")
    blocks = max(16, -(-docs.count() // rows_per_block))
    rest = [F.col(f"_rest.`{c}`") for c, t in docs.dtypes if c != key and not t.startswith(("map", "variant"))]
    placed = boxed(docs, _key=key).select(
        "*",
        jump_shard(F.col("_key"), shards).alias("shard"),
        jump_shard(F.col("_key"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit("block")), F.lit(blocks)).cast("int").alias("_block"),
    )
    sizes = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_block").orderBy(F.col("_key"), *rest)
    return (
        placed.withColumn("_at", F.row_number().over(within))
        .join(starts, ["shard", "_block"])
        .select(
            *opened(docs.columns, _key=key),
            "shard",
            "grown_shard",
            (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"),
        )
    )

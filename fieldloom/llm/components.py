"""Connected components of links, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.stage import written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``: the least node it is linked to.

    Rounds alternate two steps: every node hands its least neighbour to its larger neighbours,
    then to its smaller ones. A round leaves a star for each finished component, and about
    log(nodes) rounds finish all. Links come and go as rows; nothing is gathered.
    """
    pairs = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        # Every node's larger neighbours, hung on the least node next to it.
        both = pairs.union(pairs.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = written(large.where("a <> b").distinct())
        # Every node and its smaller neighbours, hung on the least of those.
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b")
        stars = written(small.union(least.select("a", F.col("_m").alias("b"))).distinct())
        if _same(stars, pairs):
            break
        pairs = stars
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select(F.col("b"), F.col("b")).distinct()
    )


def _same(one: DataFrame, other: DataFrame) -> bool:
    """Whether two link tables hold the same rows, by count and a sum of hashes."""

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    return mark(one) == mark(other)

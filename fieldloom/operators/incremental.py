"""Skip what is done: keys of finished work, latest rows, reuse and union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key in the given order.

    The rank filter is applied before the shuffle as well, so each task sends at most one row
    per key and a hot key stays small.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def rows_of_first(rows: DataFrame, keys: list[str], narrow: dict[str, Column], *order: Column) -> DataFrame:
    """Whole first rows per key, for rows with long columns.

    Only the keys and the ``narrow`` columns, which tell the rows of a key apart and give their
    order, are ranked; the rows they belong to are then read again by a join that needs no sort where
    the winners' measured size lets Spark broadcast them. Null keys are a key like others.
    """
    marked = rows.withColumns(narrow)
    first = first_per_key(marked.select(*keys, *narrow), keys, *order)
    names = {c: f"_first_{i}" for i, c in enumerate([*keys, *narrow])}
    first = first.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return marked.join(first, same, "left_semi").select(*rows.columns)


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Last row per key in the given order."""
    return first_per_key(rows, keys, *[F.desc(c) for c in order])


def remaining(work: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work without a finished row; all of it when forced.

    Only the distinct keys of the finished rows are shuffled, so a key that was finished many
    times is one row.
    """
    if force:
        return work
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def reusable(work: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Finished rows the work asks for; none when forced."""
    if force:
        return done.limit(0)
    return done.join(work.select(*keys).distinct(), keys, "left_semi")


def reuse_or_compute(
    work: DataFrame, done: DataFrame, keys: list[str], compute, force: bool = False
) -> DataFrame:
    """Finished rows together with ``compute`` of the remaining work."""
    computed = compute(remaining(work, done, keys, force))
    return reusable(work, done, keys, force).unionByName(computed, allowMissingColumns=True)

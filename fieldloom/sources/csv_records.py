"""CSV records whose quoted values hold line breaks, found in the blocks of a file in parallel.

Whether a line break ends a record depends on all quotes before it. A line is therefore read twice,
as if it began outside and inside a quoted value, which makes it a function from one of two states
to another. Such functions combine in any grouping, so blocks are summed up apart, a running
combination over one row per block gives each its true first state, and every task then cuts its own
block. A record that runs over the end of a block is put together where it began.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.session import cut_lineage

# Column that names the file a row came from.
SOURCE_FILE = "source_file"

# A closed piece of a quoted value (a doubled quote closes one and opens the next) or a plain value.
CLOSED = r'(?:(^|,)|\G)"[^"]*+"(?:[^",][^,]*+)?|(^|,)[^",][^,]*+'


def ends_open(line: Column) -> Column:
    """1 where a line that begins a record ends inside a quoted value, else 0."""
    return F.regexp_like(F.regexp_replace(line, CLOSED, "$1$2"), F.lit('(^|,)"')).cast("int")


def _running(window) -> tuple[Column, Column]:
    """State after all lines up to this one: a fixed one or null, and whether the state is turned.

    A line either fixes the state, leaves it, or turns it; the last line that fixes it counts, with
    the turns since.
    """
    fixes = F.col("from_out") == F.col("from_in")
    fixed = F.last(F.when(fixes, F.col("from_out")), ignorenulls=True).over(window)
    turns = F.sum(F.when(~fixes & (F.col("from_out") == 1), 1).otherwise(0)).over(window)
    return fixed, turns


def _with_state(lines: DataFrame, by: list[str], order: list[str], entry: Column) -> DataFrame:
    """Add ``before`` and ``after``, the states around each line of a group that begins in ``entry``."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fixed, turns = _running(window)
    counted = lines.withColumns({"_fixed": fixed, "_turns": turns})
    fixes = F.col("from_out") == F.col("from_in")
    since = F.col("_turns") - F.coalesce(F.last(F.when(fixes, F.col("_turns")), ignorenulls=True).over(window), F.lit(0))
    after = (F.coalesce("_fixed", entry) + since) % 2
    ordered = Window.partitionBy(*by).orderBy(*order)
    stated = counted.withColumn("after", after.cast("int"))
    return stated.withColumn("before", F.coalesce(F.lag("after").over(ordered), entry)).drop("_fixed", "_turns")


def csv_lines(spark: SparkSession, files: list[str], charset: str) -> DataFrame:
    """``file, name, block, row, at, value, glue, from_out, from_in`` of every line of the files.

    ``row`` and ``at`` order the lines of a file, ``glue`` is the line feed behind a line, if it has
    one (a lone carriage return ends a line as well, and stays at its end).
    """
    raw = spark.read.text(files, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset).alias("value"),
    )
    plain = F.when(F.col("block") == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    parts = raw.withColumn("parts", F.split(plain, r"(?<=\r)(?!$)"))
    lines = parts.select("file", "name", "block", "row", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "value"))
    return lines.select(
        "file",
        "name",
        "block",
        "row",
        "at",
        "value",
        F.when(F.col("at") + 1 == F.col("n"), "\n").otherwise("").alias("glue"),
        ends_open(F.col("value")).alias("from_out"),
        ends_open(F.concat(F.lit('"'), F.col("value"))).alias("from_in"),
    )


def block_owners(lines: DataFrame) -> DataFrame:
    """``file, block, first, owner``: the place of the first line of a block that begins a record
    (null without one), and the last block before it in which a record begins.

    Only flags are shuffled, by block, and one row per block is ordered within its file.
    """
    by, order = ["file", "block"], ["row", "at"]
    flags = lines.select(*by, *order, "from_out", "from_in")
    place = F.struct(*order)
    both = flags
    for entry in (0, 1):
        both = _with_state(both, by, order, F.lit(entry)).withColumnsRenamed(
            {"before": f"before{entry}", "after": f"after{entry}"}
        )
    blocks = both.groupBy(*by).agg(
        F.max_by("after0", place).alias("from_out"),
        F.max_by("after1", place).alias("from_in"),
        F.min(F.when(F.col("before0") == 0, place)).alias("first0"),
        F.min(F.when(F.col("before1") == 0, place)).alias("first1"),
    )
    stated = _with_state(blocks, ["file"], ["block"], F.lit(0))
    first = F.when(F.col("before") == 0, F.col("first0")).otherwise(F.col("first1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("first").isNotNull(), F.col("block")), ignorenulls=True).over(earlier)
    return stated.withColumn("first", first).withColumn("owner", owner).select(*by, "first", "owner")


def csv_records(spark: SparkSession, files: list[str], charset: str = "UTF-8") -> DataFrame:
    """``name, block, nth, text`` of every record, headers too: the records that begin in a block of
    a file are numbered from 1. Blank lines between records are left out.

    The text is shuffled once, by block; what lies before the first record of a block goes to the
    block that owns it. A task holds a block's lines sorted and one record in memory.
    """
    lines = csv_lines(spark, files, charset)
    owners = cut_lineage(block_owners(lines)).withColumnsRenamed({"file": "_file", "block": "_block"})
    met = lines.join(owners, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    is_own = F.col("first").isNotNull() & (F.struct("row", "at") >= F.col("first"))
    dealt = met.withColumn("home", F.when(is_own, F.col("block")).otherwise(F.col("owner")))
    by, order = ["file", "home"], ["block", "row", "at"]
    stated = _with_state(dealt.drop("_file", "_block", "first", "owner"), by, order, F.lit(0))
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = stated.withColumn("nth", F.sum((F.col("before") == 0).cast("int")).over(running))
    pieces = F.array_sort(F.collect_list(F.struct("block", "row", "at", F.concat("value", "glue").alias("text"))))
    records = numbered.groupBy("file", "name", "home", "nth").agg(pieces.alias("pieces"))
    text = F.regexp_replace(F.array_join(F.transform("pieces", lambda p: p["text"]), ""), r"\r?\n?\z", "")
    return records.select("name", F.col("home").alias("block"), "nth", text.alias("text")).filter("text <> ''")


def column_names(header: str) -> list[str] | None:
    """Names in a header, as Spark's reader gives them; None where the header is not whole."""
    try:
        found = next(csv.reader(io.StringIO(header, newline=""), strict=True), [])
    except csv.Error:
        return None
    lower = [n.lower() for n in found]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(found)]


def read_csv_records(spark: SparkSession, files: list[str], charset: str, header: str) -> list[DataFrame]:
    """Rows of files that share the first line of their header, with ``source_file``: one table per
    header. Values are texts, empty ones null unless quoted; missing ones at a row's end are null."""
    records = csv_records(spark, files, charset)
    is_header = (F.col("block") == 0) & (F.col("nth") == 1)
    if column_names(header) is not None:
        headers = {header: None}
    else:
        # A row per file, as when files are listed.
        headers = {}
        for row in records.filter(is_header).select("name", "text").toLocalIterator():
            headers.setdefault(row.text, []).append(row.name)
    tables = []
    for text, names in sorted(headers.items()):
        fields = column_names(text) or []
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in fields)
        own = records.filter(~is_header) if names is None else records.filter(~is_header & F.col("name").isin(names))
        parsed = own.select(F.from_csv("text", schema, {"escape": '"', "multiLine": "true"}).alias("row"), "name")
        tables.append(parsed.select("row.*", F.col("name").alias(SOURCE_FILE)))
    return tables

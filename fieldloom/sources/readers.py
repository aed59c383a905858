"""Sources: URL lists, templates, pages, stored tables, JSON and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import json as J
from fieldloom.functions import text as X
from fieldloom.operators.incremental import latest
from fieldloom.sources.csv_records import SOURCE_FILE, read_csv_records


def with_ordinal(lines: DataFrame, keep) -> DataFrame:
    """Number the kept rows of a file scan from 1, in order of file and place in the file.

    Rows are numbered inside the blocks of the scan; a running sum over one row per block gives
    each block its offset, so no task sees more than a block.
    """
    located = lines.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).filter(keep)
    numbered = located.withColumn("_row", F.monotonically_increasing_id())
    blocks = numbered.groupBy("_file", "_block").agg(
        F.count("*").alias("_rows"), F.min("_row").alias("_first")
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_file",
        "_block",
        "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
    )
    ordinal = F.col("_offset") + F.col("_row") - F.col("_first") + 1
    return (
        numbered.join(offsets, ["_file", "_block"])
        .withColumn("ordinal", ordinal)
        .drop("_file", "_block", "_row", "_first", "_offset")
    )


def read_url_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``ordinal, url_id, url_key, url``: trimmed lines without blank and ``#`` lines.

    Order and duplicates are kept.
    """
    lines = spark.read.text(path)
    url = X.strip(F.col("value"))
    keep = (url != "") & ~F.startswith(url, F.lit("#"))
    return with_ordinal(lines, keep).select(
        "ordinal",
        X.url_id(F.col("ordinal")).alias("url_id"),
        X.url_key(url).alias("url_key"),
        url.alias("url"),
    )


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """One-row ``template`` from the one UTF-8 text file of a path, stripped.

    Several files, or none, are an error: which one counts would be chance.
    """
    whole = spark.read.text(path, wholetext=True)
    found = whole.count()
    if found != 1:
        raise ValueError(f"{path} holds {found} templates; exactly one is needed")
    return whole.select(X.strip(F.col("value")).alias("template"))


def read_json_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, modified, text, record``: one JSON document per file, null when it is not valid."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("text"),
        J.strict_json(F.col("value")).alias("record"),
    )


def readable(records: DataFrame) -> DataFrame:
    """Files that hold valid JSON."""
    return records.filter(F.col("record").isNotNull())


def unreadable(records: DataFrame) -> DataFrame:
    """Files for quarantine."""
    return records.filter(F.col("record").isNull())


def result_fields(records: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and the fields of result records, unreadable ones left out."""
    record = F.col("record")

    def field(name: str, kind: str):
        return F.try_variant_get(record, f"$.{name}", kind).alias(name)

    return readable(records).select(
        *keep,
        field("url", "string"),
        field("url_id", "string"),
        field("timestamp", "double"),
        field("content_length", "int"),
        field("data", "variant"),
        field("error", "string"),
    )


def read_result_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Result records from JSON files, unreadable files left out."""
    return result_fields(read_json_files(spark, path), "file")


def read_results_with_data(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Result records from JSON files that hold data."""
    return read_result_files(spark, path).filter(J.has_data(F.col("data")))


def latest_by_modification(records: DataFrame, keys: list[str]) -> DataFrame:
    """Most recently written record per key."""
    return latest(records, keys, "modified", "file")


def csv_kinds(spark: SparkSession, path: str | list[str], fallback: str) -> DataFrame:
    """``file, charset, multiline, header`` of CSV files.

    A file is UTF-8 where all its bytes are valid, else in the named fallback. It is multi-line
    where some line has an odd number of quotes, so that a quoted value goes on behind the line.
    ``header`` is the first line in that character set. Lines are tested where they are read, so a large
    file is split over tasks and only one row per file and task is shuffled.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.is_valid_utf8("value").alias("valid"),
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).alias("open"),
        F.when(F.col("_metadata.file_block_start") == 0, F.col("value")).alias("value"),
    )
    found = lines.groupBy("file").agg(
        F.bool_and("valid").alias("valid"),
        F.bool_or("open").alias("multiline"),
        F.min_by("value", F.struct("block", "row")).alias("header"),
    )
    decoded = F.decode(F.col("header").cast("binary"), fallback)
    return found.select(
        "file",
        F.when(F.col("valid"), "UTF-8").otherwise(fallback).alias("charset"),
        "multiline",
        F.when(F.col("valid"), F.regexp_replace("header", "^\ufeff", "")).otherwise(decoded).alias("header"),
    )


def csv_charsets(spark: SparkSession, path: str | list[str], fallback: str) -> DataFrame:
    """``file, charset`` of CSV files."""
    return csv_kinds(spark, path, fallback).select("file", "charset")


def read_csv_groups(
    spark: SparkSession, path: str | list[str], fallback: str = "windows-1256", **options
) -> list[DataFrame]:
    """CSV files with a header: one table per group of files that read alike, with ``source_file``.

    Quotes in values are doubled, values may hold commas, quotes and line breaks, and headers may
    differ between groups. Files are split over tasks, those with line breaks in values as well;
    with options of the caller's own the latter are read by Spark, one task each. One row per file
    reaches the driver, as in any file listing of Spark; contents do not.
    """
    named = {"header": True, "enforceSchema": False, "escape": '"', **options}
    groups: dict[tuple, list[str]] = {}
    for row in csv_kinds(spark, path, fallback).toLocalIterator():
        groups.setdefault((row.charset, row.multiline, row.header), []).append(row.file)
    read = []
    for (charset, multiline, header), files in sorted(groups.items(), key=lambda g: min(g[1])):
        if multiline and not options:
            read += read_csv_records(spark, sorted(files), charset, header)
        else:
            whole = spark.read.options(**named).csv(sorted(files), encoding=charset, multiLine=multiline)
            read.append(whole.select("*", F.col("_metadata.file_name").alias(SOURCE_FILE)))
    return read


def read_csv_any_charset(
    spark: SparkSession, path: str | list[str], fallback: str = "windows-1256", **options
) -> DataFrame:
    """All rows of CSV files with a header, each file read in its own character set.

    Columns that a file lacks are null; the name of the file is not kept.
    """
    parts = [df.drop(SOURCE_FILE) for df in read_csv_groups(spark, path, fallback, **options)]
    if not parts:
        return spark.read.options(header=True, **options).csv(path)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole

"""Results to the wide table, its statistics and its exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import constants as C
from fieldloom.functions import json as J
from fieldloom.functions import text as X
from fieldloom.operators.flatten import flatten_results
from fieldloom.operators.profile import profile_fields
from fieldloom.operators.schema import MAX_COLUMNS, WideColumn, collect_columns, derive_schema
from fieldloom.operators.unify import unify, unify_objects
from fieldloom.session import configure, cut_lineage
from fieldloom.sources import readers as R
from fieldloom.sources import writers as W


@dataclass
class FinalTable:
    """The wide table with what it was derived from."""

    records: DataFrame
    profile: DataFrame
    schema: DataFrame
    columns: list[WideColumn]
    table: DataFrame


def build_final_table(
    results: DataFrame,
    order: str = "ordinal",
    threshold: float = C.MIN_FIELD_FREQUENCY,
    misc_limit: int = C.MAX_MISC_ITEMS,
    strict_compat: bool = False,
    max_columns: int = MAX_COLUMNS,
    stage: str | None = None,
) -> FinalTable:
    """Flatten, profile, derive the schema and project results (``url_id, url, data``, order).

    With ``stage``, the flat records are written there once and everything reads them back; without,
    each use flattens the results again. More than ``max_columns`` standard fields are an error; the
    flat records stay as written.
    """
    spark = configure(results.sparkSession)
    records = flatten_results(results).select(order, "fields")
    if stage is not None:
        W.write_table(records, stage)
        records = spark.read.schema(records.schema).parquet(stage)
    profile = cut_lineage(profile_fields(records, order))
    schema = derive_schema(profile, threshold, strict_compat)
    columns = collect_columns(schema, max_columns)
    table = unify(records, columns, misc_limit=misc_limit)
    return FinalTable(records, profile, schema, columns, table)


def profile_as_json(profile: DataFrame) -> DataFrame:
    """Profile in the form of the report, without internal columns."""
    return profile.drop("has_wide_ints")


def save_final_table(results: DataFrame, output: str, order: str = "ordinal", **options) -> bool:
    """Write the table and its exports under ``output``; false when no result holds data.

    Flat records and the wide table are written once, beside each other, and all else reads them
    back. The stamped folder is kept,
    ``latest`` is replaced by each run.
    """
    spark = configure(results.sparkSession)
    stamp = spark.range(1).select(X.run_stamp().alias("s")).first()["s"]
    folder, latest = f"{output}/{stamp}", f"{output}/latest"
    if results.filter(J.has_data(F.col("data"))).isEmpty():  # stops at the first record with data
        return False
    built = build_final_table(results, order, stage=f"{folder}/tables/records", **options)

    W.write_table(built.profile, f"{folder}/tables/field_analysis")
    profile = spark.read.parquet(f"{folder}/tables/field_analysis")
    W.write_table(built.table, f"{folder}/tables/data")
    table = spark.read.parquet(f"{folder}/tables/data")
    jobs = unify_objects(built.records, built.columns)

    fields = derive_schema(
        profile, options.get("threshold", C.MIN_FIELD_FREQUENCY), options.get("strict_compat", False)
    )
    # One row per field of a checked schema and its profile, as two lists beside the totals.
    rows = F.array_sort(F.collect_list(F.struct("position", "field", "role", "kind")))
    analysis = F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in profile_as_json(profile).columns if c != "types"))))
    parts = [
        table.agg(F.count("*").alias("total_jobs")).withColumn("timestamp", F.lit(stamp)),
        fields.agg(F.transform(rows, lambda r: F.struct(r["field"].alias("field"), r["role"].alias("role"), r["kind"].alias("kind"))).alias("schema")),
        profile.agg(analysis.alias("field_analysis")),
    ]
    one = [part.withColumn("_one", F.lit(1)) for part in parts]
    metadata = one[0].join(one[1], "_one").join(one[2], "_one").drop("_one")
    W.write_json(profile_as_json(profile), f"{folder}/field_analysis_report")
    W.write_objects(jobs, "job", f"{folder}/full_data/jobs")
    W.write_lines(spark.read.text(f"{folder}/full_data/jobs"), f"{latest}/full_data/jobs")
    for target in (folder, latest):
        W.write_csv(table, f"{target}/analysis_csv")
        W.write_json(metadata, f"{target}/full_data/metadata")
        W.write_json(fields, f"{target}/full_data/schema")
    return True


def rebuild_from_files(spark: SparkSession, path: str | list[str], output: str, **options) -> bool:
    """Final table from stored JSON result files, in a fixed but arbitrary file order."""
    found = R.read_results_with_data(configure(spark), path)
    ordered = found.withColumn("ordinal", F.xxhash64("file"))
    return save_final_table(ordered, output, **options)

"""Common schema from field statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import constants as C

# A wider table is refused, not cut: raise the limit or the frequency threshold.
MAX_COLUMNS = 5_000
# Places the facts of one field are dealt to when they meet their role.
ROLE_SALTS = 64


@dataclass(frozen=True)
class WideColumn:
    """A column of the wide table."""

    field: str
    kind: str


def priority_fields(spark: SparkSession) -> DataFrame:
    """Priority fields with their position."""
    names = F.array(*[F.lit(f) for f in C.PRIORITY_FIELDS])
    return spark.range(1).select(F.posexplode(names).alias("priority", "field"))


def _kind(strict_compat: bool) -> Column:
    field, types = F.col("field"), F.map_keys("types")

    def is_only(*names: str) -> Column:
        others = F.array_except(types, F.array(*[F.lit(n) for n in names]))
        return (F.size(types) > 0) & (F.size(others) == 0)

    is_number = field.isin(C.NUMBER_FIELDS)
    if strict_compat:
        is_number = is_number | F.contains(F.lower(field), F.lit("salary"))
    is_flag = F.contains(F.lower(field), F.lit("remote")) | F.endswith(field, F.lit("_flag"))
    return (
        F.when(is_number, "double")
        .when(is_flag, "boolean")
        .when(is_only("bool"), "boolean")
        .when(is_only("int") & ~F.col("has_wide_ints"), "bigint")
        .when(is_only("int", "float") & ~F.col("has_wide_ints"), "double")
        .otherwise("string")
    )


def derive_schema(
    profile: DataFrame,
    threshold: float = C.MIN_FIELD_FREQUENCY,
    strict_compat: bool = False,
) -> DataFrame:
    """``field, role, position, kind``: standard fields are columns, the others go to misc.

    Standard are the priority fields and all whose non-null frequency reaches the threshold.
    Columns follow ``position``, which all fields beside the priority ones share, then the name.
    """
    priority = priority_fields(profile.sparkSession)
    joined = profile.join(priority, "field", "full_outer").filter(
        F.col("field") != C.MISC_COLUMN
    )
    is_standard = F.col("priority").isNotNull() | (F.col("non_null_frequency") >= threshold)
    return joined.select(
        "field",
        F.when(is_standard, "standard").otherwise("misc").alias("role"),
        F.coalesce("priority", F.lit(len(C.PRIORITY_FIELDS))).alias("position"),
        F.coalesce(_kind(strict_compat), F.lit("string")).alias("kind"),
    )


def label_facts(facts: DataFrame, schema: DataFrame, salts: int = ROLE_SALTS) -> DataFrame:
    """Long form with the role of each field, for tables too wide to project.

    A field of every record is dealt over ``salts`` places by the task its facts come from, and each
    role is there ``salts`` times; Spark broadcasts roles instead where their measured size is small.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    roles = schema.select("field", "role").withColumn("_salt", copies)
    dealt = facts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return dealt.join(roles, ["field", "_salt"]).drop("_salt")


def collect_columns(schema: DataFrame, limit: int = MAX_COLUMNS) -> list[WideColumn]:
    """Standard columns in order; the only rows that reach the driver, and a checked number."""
    rows = (
        schema.filter("role = 'standard'")
        .select("field", "kind", "position")
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(
            f"more than {limit} standard fields: raise the frequency threshold or the limit,"
            " or use the long form"
        )
    return [WideColumn(r.field, r.kind) for r in sorted(rows, key=lambda r: (r.position, r.field))]

"""Flat records to the wide table: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import constants as C
from fieldloom.functions import json as J
from fieldloom.functions import text as X
from fieldloom.operators.schema import WideColumn


def shown_or_raw(fields: Column, raw: list[str]) -> Column:
    """Shown text per field, lists joined and objects as JSON; the ``raw`` fields stay as they are."""

    def value_of(name: Column, value: Column) -> Column:
        def shown(kind: Column) -> Column:
            return F.when(kind == "list", J.list_text(value)).otherwise(J.value_text(value, kind))

        text = X.let(J.value_type(value), shown).cast("variant")
        return F.when(name.isin(raw), value).otherwise(text) if raw else text

    return F.transform_values(fields, value_of)


def wide_struct(fields: Column, columns: list[WideColumn]) -> Column:
    """All columns as one struct, ``c0, c1, ...``, read from the record's entries in one pass over
    the names, so that the work grows with the width and not with its square.

    What does not fit its kind is null. Numbers and flags read from text stay VARIANT here. Names
    may be any text and may differ in case only, so they are left behind for places.
    """
    stored = {"string": T.StringType(), "bigint": T.LongType()}
    kinds = [stored.get(c.kind, T.VariantType()) for c in columns]
    quoted = [f"`{c.field.replace('`', '``')}`" for c in columns]
    by_name = ", ".join(f"{name}: {kind.simpleString()}" for name, kind in zip(quoted, kinds, strict=True))
    by_place = T.StructType([T.StructField(f"c{i}", kind) for i, kind in enumerate(kinds)])
    values = shown_or_raw(fields, [c.field for c in columns if c.kind != "string"])
    return F.try_variant_get(F.to_variant_object(values), "$", f"struct<{by_name}>").cast(by_place)


def wide_value(value: Column, kind: str) -> Column:
    """Value of a column from its place in the struct, coerced to its kind."""
    if kind in ("string", "bigint"):
        return value
    text = J.raw_text(value)
    return X.to_number(text) if kind == "double" else X.to_boolean(text)


def misc_fields(fields: Column, standard: list[str], limit: int = C.MAX_MISC_ITEMS) -> Column:
    """Non-null fields that are no columns, the first by name up to the limit, else null.

    A misc value the record brings itself is merged in: its entries when it is an object, else
    under its own name.
    """
    supplied = F.try_element_at(fields, F.lit(C.MISC_COLUMN))
    named = [*standard, C.MISC_COLUMN]  # a list of literals is looked up as a hash set
    own = J.object_map(supplied)
    whole = F.when(own.isNull() & ~J.is_null(supplied), F.create_map(F.lit(C.MISC_COLUMN), supplied))
    rest = F.map_filter(fields, lambda k, _: ~k.isin(named))
    filled = F.map_filter(J.merge_maps(own, whole, rest), lambda _, v: ~J.is_null(v))

    def first_by_name(m: Column) -> Column:
        names = F.slice(F.array_sort(F.map_keys(m)), 1, limit)
        kept = F.transform(names, lambda k: F.struct(k, F.element_at(m, k)))
        return F.when(F.size(m) > 0, F.map_from_entries(kept))

    return X.let(filled, first_by_name)


def unify(
    records: DataFrame,
    columns: list[WideColumn],
    fields: str = "fields",
    misc_limit: int = C.MAX_MISC_ITEMS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Wide table: every standard column, absent fields null, and the misc column as JSON text."""
    m = F.col(fields)
    misc = F.to_json(misc_fields(m, [c.field for c in columns], misc_limit)).alias(C.MISC_COLUMN)
    wide = [wide_value(F.col(f"_wide.c{i}"), c.kind).alias(c.field) for i, c in enumerate(columns)]
    # Read by many columns, so the optimizer computes the struct once, below them.
    placed = records.withColumn("_wide", wide_struct(m, columns)) if columns else records
    return placed.select(*(keep or []), *wide, misc)


def unify_objects(
    records: DataFrame,
    columns: list[WideColumn],
    fields: str = "fields",
    misc_limit: int = C.MAX_MISC_ITEMS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The same records before coercion: ``job`` holds standard fields and misc as VARIANT."""
    m = F.col(fields)
    null = F.parse_json(F.lit("null"))
    names = [c.field for c in columns]
    standard = F.map_filter(m, lambda k, _: k.isin(names)) if names else F.create_map().cast("map<string,variant>")
    misc = F.create_map(F.lit(C.MISC_COLUMN), F.coalesce(F.to_variant_object(misc_fields(m, names, misc_limit)), null))
    blank = F.map_from_arrays(F.lit(names).cast("array<string>"), F.array_repeat(null, len(names)))
    job = J.merge_maps(blank, standard, misc)
    return records.select(*(keep or []), F.to_variant_object(job).alias("job"))

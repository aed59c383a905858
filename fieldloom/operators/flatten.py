"""Result records to flat fields: one map per record, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import constants as C
from fieldloom.functions import json as J
from fieldloom.functions import text as X


def _get(block: Column, key: str) -> Column:
    return F.try_element_at(block, F.lit(key))


def _pick(block: Column, picks: dict[str, Column]) -> Column:
    """Fields of a block under their flat names; null when the block is absent."""
    entries = [part for name, value in picks.items() for part in (F.lit(name), value)]
    return F.when(block.isNotNull(), F.create_map(*entries))


def _joined(block: Column, key: str) -> Column:
    """List as joined text: empty when absent, null when null, text as it is."""

    def joined(value: Column) -> Column:
        return (
            F.when(value.isNull(), F.lit("").cast("variant"))
            .when(J.value_type(value) == "list", J.list_text(value).cast("variant"))
            .otherwise(value)
        )

    return X.let(_get(block, key), joined)


def _payment(block: Column) -> Column:
    return _pick(
        block,
        {
            "estimated_salary_irr": _get(block, "estimated_range_irr"),
            "salary_reasoning": _get(block, "reasoning"),
        },
    )


def _fit(block: Column) -> Column:
    return _pick(
        block,
        {
            "fit_tier": _get(block, "tier"),
            "fit_summary": _get(block, "summary"),
            "fit_strengths": _joined(block, "strengths"),
            "fit_gaps": _joined(block, "gaps"),
        },
    )


def _judged(value: Column) -> Column:
    """A plain value stands for itself, without a reason."""

    def pick(block: Column) -> Column:
        return _pick(
            value,
            {
                "is_overqualified": F.when(block.isNull(), value).otherwise(_get(block, "value")),
                "overqualified_reasoning": _get(block, "reasoning"),
            },
        )

    return X.let(J.object_map(value), pick)


def flat_fields(data: Column) -> Column:
    """Flat ``map<string,variant>`` of a nested analysis; on equal names the later block counts."""

    def flatten(blocks: Column) -> Column:
        def block(name: str) -> Column:
            return J.object_map(_get(blocks, name))

        return J.merge_maps(
            block("standard_extraction"),
            X.let(block("payment_analysis"), _payment),
            X.let(block("candidate_fit"), _fit),
            X.let(_get(blocks, "is_overqualified"), _judged),
            X.let(
                _get(blocks, "growth_potential"), lambda value: _pick(value, {"growth_potential": value})
            ),
        )

    return X.let(J.object_map(data), flatten)


def flatten_results(
    results: DataFrame, data: str = "data", url_id: str = "url_id", url: str = "url"
) -> DataFrame:
    """Records with data, with their flat fields and identity fields in ``fields``."""
    identity = F.create_map(
        F.lit("url_id"),
        F.col(url_id).cast("variant"),
        F.lit("source_url"),
        F.col(url).cast("variant"),
    )
    return results.filter(J.has_data(F.col(data))).withColumn(
        "fields", J.merge_maps(flat_fields(F.col(data)), identity)
    )


def field_facts(records: DataFrame, order: str, fields: str = "fields") -> DataFrame:
    """Long form: one row per record and field, with the type and the sample text of the value.

    A record without fields keeps one row with a null field, so records stay countable.
    """
    exploded = records.select(order, F.posexplode_outer(fields).alias("_at", "field", "value"))
    # Schema and text are columns of their own, so each is read from the VARIANT once.
    value = F.col("value")
    read = exploded.select(order, "_at", "field", F.schema_of_variant(value).alias("schema"), J.raw_text(value).alias("text"))
    typed = read.select(order, "_at", "field", J.type_of_schema(F.col("schema")).alias("type"), "text")
    shown = J.typed_text(F.col("text"), F.col("type"))
    return typed.select(
        order,
        "field",
        "type",
        F.left(shown, F.lit(C.SAMPLE_LENGTH)).alias("sample"),
        (F.coalesce("_at", F.lit(0)) == 0).alias("starts_record"),
    )

"""Field profile: counts, type histogram, first samples and frequencies per field."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom import constants as C
from fieldloom.functions import json as J
from fieldloom.operators.flatten import field_facts
from fieldloom.session import cut_lineage

# Names in the type histogram.
TYPES = ["str", "int", "float", "bool", "list", "dict"]

# Facts a task combines at a time, and fields it keeps before it hands them on and starts afresh.
STEP_FACTS = 100_000
HELD_FIELDS = 100_000

_NUMBERS = ["count", "non_null_count", "records", "wide_ints", *TYPES]
_PARTIAL = "field string, " + ", ".join(f"{name} long" for name in _NUMBERS) + ", firsts array<struct<at:long,sample:string>>"


def _filled() -> Column:
    """Neither null nor empty text."""
    return F.col("sample") != ""


class FieldStates:
    """Per field its numbers and the earliest distinct samples, from facts in any order.

    States of the same field merge by adding the numbers and taking the earliest samples of both.
    """

    def __init__(self):
        self.numbers: dict[str | None, list[int]] = {}
        self.firsts: dict[str, dict[str, int]] = {}
        # By when a field's kept samples had all been seen; a later fact cannot be one of them.
        self.closed: dict[str, int] = {}

    def add(self, facts: pa.Table) -> None:
        """Take up facts: ``at, field, type, sample, starts_record, filled, wide``."""
        sums = facts.group_by(["field", "type"]).aggregate([("filled", "count"), ("filled", "sum"), ("starts_record", "sum"), ("wide", "sum")])
        for field, kind, count, filled, starts, wide in zip(
            *(sums.column(name).to_pylist() for name in ("field", "type", "filled_count", "filled_sum", "starts_record_sum", "wide_sum")), strict=True
        ):
            own = self.numbers.setdefault(field, [0] * len(_NUMBERS))
            own[0] += count if field is not None else 0
            own[1] += filled or 0
            own[2] += starts or 0
            own[3] += wide or 0
            if kind in TYPES:
                own[4 + TYPES.index(kind)] += filled or 0
        open_ = facts.filter(facts.column("filled"))
        if self.closed:
            place = pc.index_in(open_.column("field"), pa.array(list(self.closed)))
            bound = pc.take(pa.array(list(self.closed.values()), pa.int64()), place)
            open_ = open_.filter(pc.fill_null(pc.less(open_.column("at"), bound), True))
        if not open_.num_rows:
            return
        seen = open_.group_by(["field", "sample"]).aggregate([("at", "min")]).sort_by("at_min")
        for field, sample, at in zip(*(seen.column(name).to_pylist() for name in ("field", "sample", "at_min")), strict=True):
            own = self.firsts.setdefault(field, {})
            if sample in own:
                own[sample] = min(own[sample], at)
            elif len(own) < C.MAX_SAMPLES:
                own[sample] = at
            else:
                last = max(own, key=lambda s: (own[s], s))
                if (at, sample) < (own[last], last):
                    del own[last]
                    own[sample] = at
        for field in set(seen.column("field").to_pylist()):
            own = self.firsts[field]
            if len(own) == C.MAX_SAMPLES:
                self.closed[field] = max(own.values()) + 1  # what came with the last one may go before it

    def rows(self) -> pa.RecordBatch:
        """One row per field."""
        fields = list(self.numbers)
        arrays = [pa.array(fields, pa.string())]
        arrays += [pa.array([self.numbers[field][i] for field in fields], pa.int64()) for i in range(len(_NUMBERS))]
        firsts = [[{"at": at, "sample": sample} for sample, at in self.firsts.get(field, {}).items()] for field in fields]
        arrays.append(pa.array(firsts, pa.list_(pa.struct([("at", pa.int64()), ("sample", pa.string())]))))
        return pa.RecordBatch.from_arrays(arrays, names=["field", *_NUMBERS, "firsts"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The facts of a task as one state per field."""
    states, held, size = FieldStates(), [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= STEP_FACTS:
            states.add(pa.Table.from_batches(held))
            held, size = [], 0
            if len(states.numbers) > HELD_FIELDS:
                yield states.rows()
                states = FieldStates()
    if held:
        states.add(pa.Table.from_batches(held))
    if states.numbers:
        yield states.rows()


def _field_states(facts: DataFrame, order: str) -> DataFrame:
    """A few rows per field, one from each task: numbers and earliest samples. Checkpointed, so
    the input is read once whatever is made of them."""
    is_wide = (F.col("type") == "int") & F.col("sample").try_cast("bigint").isNull()
    narrow = facts.select(
        F.col(order).cast("long").alias("at"),
        "field",
        "type",
        "sample",
        "starts_record",
        F.coalesce(_filled(), F.lit(False)).alias("filled"),
        F.coalesce(is_wide, F.lit(False)).alias("wide"),
    )
    return cut_lineage(narrow.mapInArrow(_combine, _PARTIAL))


def _first_samples(states: DataFrame) -> DataFrame:
    """First distinct samples per field by arrival, from those of every task; the rank filter is
    also applied before its shuffle."""
    firsts = states.select("field", F.explode("firsts").alias("first")).select("field", "first.*")
    seen = firsts.groupBy("field", "sample").agg(F.min("at").alias("at"))
    by_arrival = Window.partitionBy("field").orderBy("at", "sample")
    ranked = seen.withColumn("rank", F.row_number().over(by_arrival))
    kept = ranked.filter(F.col("rank") <= C.MAX_SAMPLES)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "sample")))
    return kept.groupBy("field").agg(F.transform(ordered, lambda s: s["sample"]).alias("samples"))


def profile_fields(records: DataFrame, order: str, fields: str = "fields") -> DataFrame:
    """Statistics of every field over all records.

    ``fields`` is a ``map<string,variant>`` and ``order`` a whole number unique to the record
    that gives arrival order. Tasks reduce their records to one state per field (numbers, and the
    earliest distinct samples); only these are shuffled. The plan is the same for any number of
    fields, and the records are read once.
    """
    states = _field_states(field_facts(records, order, fields), order)
    counts = states.groupBy("field").agg(*[F.sum(c).alias(c) for c in _NUMBERS])
    total = F.lit(states.agg(F.sum("records")).first()[0]).cast("bigint")
    samples = _first_samples(states)
    histogram = F.map_filter(
        F.create_map(*[x for t in TYPES for x in (F.lit(t), F.col(t))]), lambda _, n: n > 0
    )
    return (
        counts.filter("field is not null")
        .join(samples, "field", "left")
        .select(
            "field",
            "count",
            (F.col("count") / total).alias("frequency"),
            histogram.alias("types"),
            F.coalesce("samples", F.array().cast("array<string>")).alias("sample_values"),
            "non_null_count",
            (F.col("non_null_count") / total).alias("non_null_frequency"),
            (F.col("wide_ints") > 0).alias("has_wide_ints"),
        )
    )


def field_coverage(results: DataFrame, data: str = "data") -> DataFrame:
    """Non-null count and share per top-level key over the records with data, largest first."""
    found = results.filter(J.has_data(F.col(data))).select(J.object_map(F.col(data)).alias("m"))
    exploded = found.select(F.posexplode("m").alias("at", "field", "value"))
    counts = cut_lineage(
        exploded.groupBy("field").agg(
            F.count_if(~J.is_null(F.col("value"))).alias("count"),
            F.count_if(F.col("at") == 0).alias("records"),
        )
    )
    total = F.lit(counts.agg(F.sum("records")).first()[0]).cast("bigint")
    return (
        counts.filter("count > 0")
        .select("field", "count", (F.col("count") / total * 100).alias("percentage"))
        .orderBy(F.desc("count"), "field")
    )


def distinct_fields(results: DataFrame, data: str = "data") -> DataFrame:
    """Distinct top-level key names over the records with data."""
    found = results.filter(J.has_data(F.col(data)))
    return found.select(F.explode(F.map_keys(J.object_map(F.col(data)))).alias("field")).distinct()

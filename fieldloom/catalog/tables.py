"""Queries on field statistics, schema, the wide table and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import inputs as I
from fieldloom.catalog import register
from fieldloom.functions import json as J
from fieldloom.operators import reports
from fieldloom.operators.flatten import field_facts, flatten_results
from fieldloom.operators.outcomes import result_records
from fieldloom.operators.profile import distinct_fields, field_coverage, profile_fields
from fieldloom.operators.schema import derive_schema, label_facts
from fieldloom.plans.final_table import build_final_table
from fieldloom.session import cut_lineage


@register(f"with {I.RAGGED_SQL}, {I.PROFILE_SQL} {I.PROFILE_SELECT_SQL}")
def flagship_field_profile(spark: SparkSession, folder: str) -> DataFrame:
    return I.flat_profile(profile_fields(I.ragged_records(spark, folder), "pos"))


LINEITEM_FIELDS = {
    "l_orderkey": "int",
    "l_linenumber": "int",
    "l_partkey": "int",
    "l_suppkey": "int",
    "l_quantity": "float",
    "l_extendedprice": "float",
    "l_discount": "float",
    "l_tax": "float",
    "l_returnflag": "str",
    "l_linestatus": "str",
    "l_shipdate": "str",
}
LINEITEM_SQL = " union all ".join(
    f"select l_orderkey * 8 + l_linenumber as pos, '{name}' as field, '{kind}' as type,"
    f" {'left(' * (name == 'l_shipdate')}cast({name} as varchar){', 10)' * (name == 'l_shipdate')} as v from lineitem"
    for name, kind in LINEITEM_FIELDS.items()
)


@register(
    f"with facts as ({LINEITEM_SQL}), total as (select count(*) as n from lineitem),"
    f" {I.PROFILE_SQL} {I.PROFILE_SELECT_SQL}"
)
def lineitem_profile(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate")
    text = F.to_json(F.struct(*[day if name == "l_shipdate" else name for name in LINEITEM_FIELDS]))
    records = I.table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
        J.object_map(F.try_parse_json(text)).alias("fields"),
    )
    return I.flat_profile(profile_fields(records, "pos"))


@register(
    """
with facts as (
  select p_partkey as pos, p_brand as field, 'str' as type, p_name as v from part
), """
    + I.PROFILE_SQL
    + " select field, samples from samples"
)
def samples_top5(spark: SparkSession, folder: str) -> DataFrame:
    records = I.table(spark, folder, "part").select(
        F.col("p_partkey").alias("pos"),
        F.create_map("p_brand", F.col("p_name").cast("variant")).alias("fields"),
    )
    profile = profile_fields(records, "pos")
    return profile.select("field", F.array_join("sample_values", " | ").alias("samples"))


PRIORITY_SQL = """
priority(position, field, kind) as (
  values (0, 'url_id', 'string'), (1, 'source_url', 'string'), (2, 'job_title', 'string'),
    (3, 'company', 'string'), (4, 'location', 'string'), (5, 'salary_min', 'double'),
    (6, 'salary_max', 'double'), (7, 'currency', 'string'), (8, 'employment_type', 'string'),
    (9, 'experience_years', 'double'), (10, 'remote_work', 'boolean'),
    (11, 'required_skills', 'string'), (12, 'education_level', 'string'),
    (13, 'industry', 'string'), (14, 'department', 'string')
)
"""


@register(
    f"""
with {I.RAGGED_SQL}, {I.PROFILE_SQL}, {PRIORITY_SQL},
kinds as (
  select field,
    case when field = 'remote' then 'boolean'
      when bool_and(type = 'int') then 'bigint'
      when bool_and(type in ('int', 'float')) then 'double' else 'string' end as kind
  from type_counts group by field
)
select field, 'standard' as role, position, kind from priority
union all
select field, case when non_null_count / total.n >= 0.1 then 'standard' else 'misc' end,
  15, coalesce(kind, 'string')
from counts cross join total left join kinds using (field)
"""
)
def derived_schema(spark: SparkSession, folder: str) -> DataFrame:
    profile = profile_fields(I.ragged_records(spark, folder), "pos")
    return derive_schema(profile, threshold=0.1)


@register(
    f"""
with {I.RAGGED_SQL}, {I.PROFILE_SQL}
select facts.field,
  case when non_null_count / total.n >= 0.1 then 'standard' else 'misc' end as role,
  count(*) as facts, min(pos) as first_at
from facts join counts using (field) cross join total group by 1, 2
"""
)
def field_roles(spark: SparkSession, folder: str) -> DataFrame:
    records = I.ragged_records(spark, folder)
    schema = cut_lineage(derive_schema(profile_fields(records, "pos"), threshold=0.1))
    labelled = label_facts(field_facts(records, "pos"), schema)
    return labelled.groupBy("field", "role").agg(
        F.count("*").alias("facts"), F.min("pos").alias("first_at")
    )


@register(
    """
with records as (select * from customer where c_custkey % 10 <> 9)
select 'url_' || lpad(cast(c_custkey as varchar),
    cast(greatest(3, length(cast(c_custkey as varchar))) as integer), '0') as url_id,
  'https://example.org/' || c_name as source_url, c_name as job_title, c_mktsegment as company,
  cast(null as varchar) as location, c_acctbal as salary_min,
  case when c_custkey % 2 = 0 then c_acctbal end as salary_max,
  cast(null as varchar) as currency, cast(null as varchar) as employment_type,
  cast(c_nationkey as double) as experience_years,
  case when c_custkey % 3 = 0 then true end as remote_work,
  c_mktsegment || ', n' || c_nationkey as required_skills,
  cast(null as varchar) as education_level, cast(null as varchar) as industry,
  cast(null as varchar) as department, cast(c_nationkey as varchar) as estimated_salary_irr,
  '' || case when c_custkey % 3 = 0 then '' else c_mktsegment || ', ' || c_name end
    as fit_strengths,
  case when c_custkey % 2 = 0 then c_name end as fit_summary, left(c_mktsegment, 1) as fit_tier,
  '{"summary":"' || c_mktsegment || '"}' as growth_potential,
  c_acctbal > 5000 as is_overqualified, c_name as overqualified_reasoning,
  'by ' || c_mktsegment as salary_reasoning,
  '{' || case when c_custkey % 4 = 0 then '"bonus":"b' || c_nationkey || '","fit_gaps":""'
    else '"fit_gaps":""' || case when c_custkey % 5 = 0 then ',"perk":' || c_nationkey
      when c_custkey % 7 = 0 then ',"shift":' || (c_custkey % 2 = 0) else '' end end
    || '}' as misc_features
from records
"""
)
def unified_table(spark: SparkSession, folder: str) -> DataFrame:
    results = I.analysis_results(spark, folder)
    return build_final_table(results, threshold=0.3, misc_limit=2).table


@register(
    """
with facts as (
  select c_custkey as ordinal, 'url_id' as field, 'str' as type,
    'url_' || lpad(cast(c_custkey as varchar),
      cast(greatest(3, length(cast(c_custkey as varchar))) as integer), '0') as value
  from customer
  union all select c_custkey, 'source_url', 'str', 'https://example.org/' || c_name from customer
  union all select c_custkey, 'job_title', 'str', c_name from customer
  union all select c_custkey, 'company', 'str', c_mktsegment from customer
  union all select c_custkey, 'salary_min', 'float', cast(c_acctbal as varchar) from customer
  union all select c_custkey, 'salary_max', 'str',
    case when c_custkey % 2 = 0 then cast(c_acctbal as varchar) else 'open' end from customer
  union all select c_custkey, 'experience_years', 'int', cast(c_nationkey as varchar)
    from customer
  union all select c_custkey, 'remote_work', 'str',
    case when c_custkey % 3 = 0 then 'true' else 'hybrid' end from customer
    where c_custkey % 3 <> 2
  union all select c_custkey, 'required_skills', 'list',
    '["' || c_mktsegment || '","n' || c_nationkey || '"]' from customer
  union all select c_custkey, 'bonus', 'str', 'b' || c_nationkey from customer
    where c_custkey % 4 = 0
  union all select c_custkey, 'perk', 'int', cast(c_nationkey as varchar) from customer
    where c_custkey % 5 = 0
  union all select c_custkey, 'shift', 'bool',
    case when c_custkey % 2 = 0 then 'True' else 'False' end from customer
    where c_custkey % 7 = 0
  union all select c_custkey, 'estimated_salary_irr', 'str', cast(c_nationkey as varchar)
    from customer
  union all select c_custkey, 'salary_reasoning', 'str', 'by ' || c_mktsegment from customer
  union all select c_custkey, 'fit_tier', 'str', left(c_mktsegment, 1) from customer
  union all select c_custkey, 'fit_summary',
    case when c_custkey % 2 = 0 then 'str' end,
    case when c_custkey % 2 = 0 then c_name end from customer
  union all select c_custkey, 'fit_strengths', 'str',
    case when c_custkey % 3 = 0 then '' else c_mktsegment || ', ' || c_name end from customer
  union all select c_custkey, 'fit_gaps', 'str', '' from customer
  union all select c_custkey, 'is_overqualified', 'bool',
    case when c_acctbal > 5000 then 'True' else 'False' end from customer
  union all select c_custkey, 'overqualified_reasoning', 'str', c_name from customer
  union all select c_custkey, 'growth_potential', 'dict', '{"summary":"' || c_mktsegment || '"}'
    from customer
)
select ordinal, field, type, value from facts where ordinal % 10 <> 9
"""
)
def flat_records(spark: SparkSession, folder: str) -> DataFrame:
    facts = field_facts(flatten_results(I.analysis_results(spark, folder)), "ordinal")
    return facts.select("ordinal", "field", "type", F.col("sample").alias("value"))


def _event_results(spark: SparkSession, folder: str) -> DataFrame:
    text = F.expr(
        """concat('{"k":', get_json_object(props, '$.k'), ',"type":',
        if(event_id % 3 <> 0, concat('"', event_type, '"'), 'null'),
        if(event_id % 2 = 0, concat(',"value":', cast(value as string)), ''), '}')"""
    )
    data = F.when(F.col("event_id") % 11 != 0, F.try_parse_json(text))
    return I.table(spark, folder, "events").select(data.alias("data"))


EVENT_FACTS_SQL = """
with facts as (
  select event_id, 'k' as field, true as filled from events
  union all select event_id, 'type', event_id % 3 <> 0 from events
  union all select event_id, 'value', true from events where event_id % 2 = 0
),
kept as (select * from facts where event_id % 11 <> 0)
"""


@register(
    EVENT_FACTS_SQL
    + """
select field, count(*) filter (filled) as count,
  round(100.0 * count(*) filter (filled)
    / (select count(*) from events where event_id % 11 <> 0), 6) as percentage
from kept group by field
"""
)
def field_coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    coverage = field_coverage(_event_results(spark, folder))
    return coverage.withColumn("percentage", F.round("percentage", 6))


@register(EVENT_FACTS_SQL + "select count(distinct field) as fields from kept")
def distinct_field_count(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_fields(_event_results(spark, folder)).agg(F.count("*").alias("fields"))


def _order_results(spark: SparkSession, folder: str) -> DataFrame:
    failed = F.col("o_orderstatus") == "F"
    data = F.to_variant_object(F.struct(F.col("o_totalprice").alias("total")))
    return I.table(spark, folder, "orders").select(
        F.format_string("url_%03d", "o_orderkey").alias("url_id"),
        F.concat(F.lit("https://example.org/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.when(~failed, data).alias("data"),
        F.when(failed & (F.col("o_orderkey") % 2 == 0), F.col("o_orderpriority")).alias("error"),
    )


@register(
    """
with r as (select o_orderstatus = 'F' and o_orderkey % 2 = 0 as bad from orders)
select count(*) as total_urls, count(*) filter (not bad) as successful,
  count(*) filter (bad) as failed from r
"""
)
def run_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.run_report(_order_results(spark, folder)).drop("timestamp")


@register(
    """
select count(*) as total_urls, count(*) filter (o_orderstatus <> 'F') as successful,
  count(*) filter (o_orderstatus = 'F') as failed,
  round(count(*) filter (o_orderstatus <> 'F') / count(*), 6) as success_rate
from orders
"""
)
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = reports.run_summary(_order_results(spark, folder))
    return summary.withColumn("success_rate", F.round("success_rate", 6))


@register(
    """
select 'url_' || lpad(cast(o_orderkey as varchar),
    cast(greatest(3, length(cast(o_orderkey as varchar))) as integer), '0') as url_id,
  'https://example.org/' || o_orderkey as url,
  case when o_orderkey % 2 = 0 then o_orderpriority else 'Unknown error' end as error
from orders where o_orderstatus = 'F'
"""
)
def failed_urls(spark: SparkSession, folder: str) -> DataFrame:
    return reports.summary_failures(_order_results(spark, folder))


@register(
    """
with typed as (
  select o_orderkey, o_orderkey % 4 as part from orders
)
select o_orderkey, part <> 0 and part <> 3 as complete,
  case part when 0 then 'company' when 3 then 'company,job_title' else '' end as missing
from typed
"""
)
def required_fields(spark: SparkSession, folder: str) -> DataFrame:
    text = F.to_json(
        F.struct(
            F.expr("if(o_orderkey % 4 <> 3, o_orderpriority, null)").alias("job_title"),
            F.expr("if(o_orderkey % 4 in (1, 2), o_orderstatus, null)").alias("company"),
            F.col("o_totalprice").alias("total"),
        )
    )
    data = F.try_parse_json(text)
    required = ["company", "job_title"]
    return I.table(spark, folder, "orders").select(
        "o_orderkey",
        J.has_fields(data, required).alias("complete"),
        F.array_join(J.missing_fields(data, required), ",").alias("missing"),
    )


@register(
    """
select o_orderkey, o_orderpriority as present, '-' as absent,
  cast(null as varchar) as held_null
from orders
"""
)
def nested_values(spark: SparkSession, folder: str) -> DataFrame:
    text = F.expr("""concat('{"a":{"b":"', o_orderpriority, '","n":null}}')""")
    value, default = F.try_parse_json(text), F.lit("-").cast("variant")

    def read(*keys: str):
        return F.try_variant_get(J.nested_get(value, list(keys), default), "$", "string")

    return I.table(spark, folder, "orders").select(
        "o_orderkey",
        read("a", "b").alias("present"),
        read("a", "x").alias("absent"),
        read("a", "n").alias("held_null"),
    )


@register(
    """
select cast(doc_id as varchar) as url_key,
  case when doc_id % 5 = 0 then 'No content extracted'
    when doc_id % 5 = 1 then 'timeout' when doc_id % 5 = 2 then 'No LLM response' end as error,
  case when doc_id % 5 > 2 then cast(length(text) as integer) end as content_length,
  doc_id % 5 > 2 as has_data
from documents
"""
)
def result_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    part = F.col("doc_id") % 5
    scored = I.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("url_key"),
        F.col("source").alias("url"),
        F.when(part != 0, F.length("text")).alias("content_length"),
        F.when(part != 2, F.to_variant_object(F.struct("lang"))).alias("parsed_response"),
        F.when(part == 1, "timeout").alias("error"),
    )
    return result_records(scored).select(
        "url_key", "error", "content_length", J.has_data(F.col("data")).alias("has_data")
    )

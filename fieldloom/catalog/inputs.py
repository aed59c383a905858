"""Inputs the queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import json as J
from fieldloom.session import configure, cut_lineage, deal


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def ragged_records(spark: SparkSession, folder: str) -> DataFrame:
    """``pos, fields``: ragged JSON objects made from customers, orders and parts.

    Customers and orders leave null keys out, parts keep them as null.
    """
    customers = table(spark, folder, "customer").select(
        (F.col("c_custkey") * 3).alias("pos"),
        F.to_json(
            F.struct(
                F.col("c_name").alias("name"),
                F.expr("if(c_custkey % 3 <> 0, c_mktsegment, null)").alias("segment"),
                F.col("c_acctbal").alias("balance"),
                F.col("c_nationkey").alias("nation"),
                F.expr("if(c_custkey % 2 = 0, c_custkey % 4 = 0, null)").alias("remote"),
                F.expr(
                    "if(c_custkey % 3 = 0, array(c_mktsegment, 'n' || c_nationkey), null)"
                ).alias("skills"),
                F.expr("if(c_custkey % 5 = 0, '', null)").alias("note"),
            )
        ).alias("js"),
    )
    orders = table(spark, folder, "orders").select(
        (F.col("o_orderkey") * 3 + 1).alias("pos"),
        F.to_json(
            F.struct(
                F.expr("'order ' || o_orderpriority").alias("name"),
                F.col("o_totalprice").alias("total"),
                F.expr("if(o_orderkey % 2 = 0, o_orderstatus, null)").alias("status"),
                F.expr("cast(o_custkey % 25 as string)").alias("nation"),
                F.struct(F.col("o_orderpriority").alias("p")).alias("meta"),
            )
        ).alias("js"),
    )
    parts = table(spark, folder, "part").select(
        (F.col("p_partkey") * 3 + 2).alias("pos"),
        F.to_json(
            F.struct(
                F.col("p_name").alias("name"),
                F.col("p_size").alias("size"),
                F.col("p_retailprice").alias("balance"),
                F.expr("if(p_partkey % 4 <> 0, p_brand, null)").alias("brand"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("js"),
    )
    records = customers.unionByName(orders).unionByName(parts)
    return records.select("pos", J.object_map(F.try_parse_json("js")).alias("fields"))


# The facts of ``ragged_records`` in SQL: position, field, type, text of the value.
RAGGED_SQL = """
facts as (
  select c_custkey * 3 as pos, 'name' as field, 'str' as type, c_name as v from customer
  union all select c_custkey * 3, 'segment', 'str', c_mktsegment from customer
    where c_custkey % 3 <> 0
  union all select c_custkey * 3, 'balance', 'float', cast(c_acctbal as varchar) from customer
  union all select c_custkey * 3, 'nation', 'int', cast(c_nationkey as varchar) from customer
  union all select c_custkey * 3, 'remote', 'bool',
    case when c_custkey % 4 = 0 then 'True' else 'False' end from customer
    where c_custkey % 2 = 0
  union all select c_custkey * 3, 'skills', 'list',
    '["' || c_mktsegment || '","n' || c_nationkey || '"]' from customer where c_custkey % 3 = 0
  union all select c_custkey * 3, 'note', 'str', '' from customer where c_custkey % 5 = 0
  union all select o_orderkey * 3 + 1, 'name', 'str', 'order ' || o_orderpriority from orders
  union all select o_orderkey * 3 + 1, 'total', 'float', cast(o_totalprice as varchar)
    from orders
  union all select o_orderkey * 3 + 1, 'status', 'str', o_orderstatus from orders
    where o_orderkey % 2 = 0
  union all select o_orderkey * 3 + 1, 'nation', 'str', cast(o_custkey % 25 as varchar)
    from orders
  union all select o_orderkey * 3 + 1, 'meta', 'dict', '{"p":"' || o_orderpriority || '"}'
    from orders
  union all select p_partkey * 3 + 2, 'name', 'str', p_name from part
  union all select p_partkey * 3 + 2, 'size', 'int', cast(p_size as varchar) from part
  union all select p_partkey * 3 + 2, 'balance', 'float', cast(p_retailprice as varchar)
    from part
  union all select p_partkey * 3 + 2, 'brand', 'str',
    case when p_partkey % 4 <> 0 then p_brand end from part
),
total as (
  select (select count(*) from customer) + (select count(*) from orders)
    + (select count(*) from part) as n
)
"""

# Field statistics in SQL over ``facts`` and ``total``.
PROFILE_SQL = """
filled as (select * from facts where v is not null and v <> ''),
counts as (
  select field, count(*) as count, count(*) filter (v is not null and v <> '') as non_null_count
  from facts group by field
),
type_counts as (select field, type, count(*) as n from filled group by field, type),
types as (
  select field, string_agg(type || ':' || n, ',' order by type) as types
  from type_counts group by field
),
seen as (
  select field, left(v, 100) as sample, min(pos) as first_pos from filled group by field, left(v, 100)
),
ranked as (
  select *, row_number() over (partition by field order by first_pos, sample) as rank from seen
),
samples as (
  select field, string_agg(sample, ' | ' order by rank) as samples
  from ranked where rank <= 5 group by field
)
"""

PROFILE_SELECT_SQL = """
select counts.field, counts.count, round(counts.count / total.n, 6) as frequency,
  coalesce(types, '') as types, coalesce(samples, '') as samples, non_null_count,
  round(non_null_count / total.n, 6) as non_null_frequency
from counts cross join total left join types using (field) left join samples using (field)
"""


def flat_profile(profile: DataFrame) -> DataFrame:
    """Field statistics with types and samples as text."""
    pairs = F.transform(
        F.array_sort(F.map_entries("types")),
        lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")),
    )
    return profile.select(
        "field",
        "count",
        F.round("frequency", 6).alias("frequency"),
        F.array_join(pairs, ",").alias("types"),
        F.array_join("sample_values", " | ").alias("samples"),
        "non_null_count",
        F.round("non_null_frequency", 6).alias("non_null_frequency"),
    )


def analysis_results(spark: SparkSession, folder: str) -> DataFrame:
    """``ordinal, url_id, url, data, error``: nested analyses made from customers."""
    standard = F.struct(
        F.col("c_name").alias("job_title"),
        F.col("c_mktsegment").alias("company"),
        F.col("c_acctbal").alias("salary_min"),
        F.expr("if(c_custkey % 2 = 0, cast(c_acctbal as string), 'open')").alias("salary_max"),
        F.col("c_nationkey").alias("experience_years"),
        F.expr(
            "case c_custkey % 3 when 0 then 'true' when 1 then 'hybrid' end"
        ).alias("remote_work"),
        F.expr("array(c_mktsegment, 'n' || c_nationkey)").alias("required_skills"),
        F.expr("if(c_custkey % 4 = 0, 'b' || c_nationkey, null)").alias("bonus"),
        F.expr("if(c_custkey % 5 = 0, c_nationkey, null)").alias("perk"),
        F.expr("if(c_custkey % 7 = 0, c_custkey % 2 = 0, null)").alias("shift"),
    )
    payment = F.struct(
        F.expr("cast(c_nationkey as string)").alias("estimated_range_irr"),
        F.expr("'by ' || c_mktsegment").alias("reasoning"),
    )
    fit = F.struct(
        F.expr("left(c_mktsegment, 1)").alias("tier"),
        F.expr("if(c_custkey % 2 = 0, c_name, null)").alias("summary"),
        F.expr("if(c_custkey % 3 <> 0, array(c_mktsegment, c_name), null)").alias("strengths"),
    )
    judged = F.struct(
        F.expr("c_acctbal > 5000").alias("value"), F.col("c_name").alias("reasoning")
    )
    growth = F.struct(F.col("c_mktsegment").alias("summary"))
    text = F.to_json(
        F.struct(
            standard.alias("standard_extraction"),
            payment.alias("payment_analysis"),
            fit.alias("candidate_fit"),
            judged.alias("is_overqualified"),
            growth.alias("growth_potential"),
        )
    )
    # Cut off there: a filter on what is made of the rows would be moved to before they are dealt.
    customers = cut_lineage(deal(table(spark, folder, "customer")))
    return customers.select(
        F.col("c_custkey").alias("ordinal"),
        F.format_string("url_%03d", "c_custkey").alias("url_id"),
        F.concat(F.lit("https://example.org/"), F.col("c_name")).alias("url"),
        F.when(F.col("c_custkey") % 10 != 9, F.try_parse_json(text)).alias("data"),
        F.when(F.col("c_custkey") % 10 == 9, F.col("c_mktsegment")).alias("error"),
    )

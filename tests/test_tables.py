import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldloom import constants as C
from fieldloom.functions import json as J
from fieldloom.operators import profile as profile_ops
from fieldloom.operators.content import largest_block
from fieldloom.operators.flatten import field_facts, flatten_results
from fieldloom.operators.profile import distinct_fields, field_coverage, profile_fields
from fieldloom.operators.schema import WideColumn, collect_columns, derive_schema
from fieldloom.operators.unify import unify, unify_objects
from fieldloom.plans.final_table import build_final_table


def records_of(spark, objects, parts=3):
    rows = [(i, json.dumps(o)) for i, o in enumerate(objects)]
    df = spark.createDataFrame(rows, "pos long, js string").repartition(parts)
    return df.select("pos", J.object_map(F.parse_json("js")).alias("fields"))


def results_of(spark, datas):
    rows = [(i, f"url_{i:03d}", f"u{i}", None if d is None else json.dumps(d))
            for i, d in enumerate(datas, 1)]
    df = spark.createDataFrame(rows, "ordinal long, url_id string, url string, js string")
    return df.withColumn("data", F.parse_json("js"))


def python_text(value):
    if isinstance(value, (dict, list)):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return str(value)


def python_profile(objects):
    """Statistics by a plain loop in arrival order."""
    stats = {}
    for record in objects:
        for field, value in record.items():
            s = stats.setdefault(field, [0, 0, Counter(), []])
            s[0] += 1
            if value is not None and value != "":
                s[1] += 1
                s[2][type(value).__name__] += 1
                text = python_text(value)[:100]
                if len(s[3]) < 5 and text not in s[3]:
                    s[3].append(text)
    n = len(objects)
    return {
        f: (s[0], s[0] / n, dict(s[2]), s[3], s[1], s[1] / n) for f, s in stats.items()
    }


def spark_profile(profile):
    return {
        r.field: (r["count"], r.frequency, r.types, r.sample_values, r.non_null_count,
                  r.non_null_frequency)
        for r in profile.collect()
    }


SMALL = [{"a": 1, "b": "x"}, {"a": None, "b": ""}, {"a": 2.5}, {"b": "x"}]


def test_small_profile(spark):
    assert spark_profile(profile_fields(records_of(spark, SMALL), "pos")) == python_profile(SMALL)


def random_objects(seed, n):
    """Skewed fields: one constant, one of few values, one unique, late and rare ones."""
    pick = random.Random(seed)
    objects = []
    for i in range(n):
        o = {"same": "x", "few": pick.choice(["a", "b", "c", True, 1, 1.0]), "unique": f"v{i}"}
        if i > n * 0.8:
            o["late"] = pick.choice([1, 2, 3, 40000000.0, None, ""])
        if pick.random() < 0.02:
            o["rare"] = {"k": [pick.randint(0, 9)]}
        if pick.random() < 0.5:
            o[f"f{pick.randint(0, 20)}"] = pick.choice([None, "", "é" * 150, i % 7, [i % 3]])
        objects.append(o)
    return objects


@pytest.mark.parametrize("step", [1, 7, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_profile_matches_loop(spark, monkeypatch, seed, step):
    monkeypatch.setattr(profile_ops, "STEP_FACTS", step)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        objects = [*random_objects(seed, 400), {}]
        expected = python_profile(objects)
        assert spark_profile(profile_fields(records_of(spark, objects, 1), "pos")) == expected
        assert spark_profile(profile_fields(records_of(spark, objects, 8), "pos")) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)


def test_states_handed_on_early_merge(spark, monkeypatch):
    monkeypatch.setattr(profile_ops, "STEP_FACTS", 5)
    monkeypatch.setattr(profile_ops, "HELD_FIELDS", 2)
    objects = random_objects(3, 200)
    assert spark_profile(profile_fields(records_of(spark, objects), "pos")) == python_profile(objects)


def test_first_samples_do_not_depend_on_the_order_of_facts(spark):
    objects = random_objects(4, 300)
    shuffled = records_of(spark, objects, 3).orderBy(F.xxhash64("pos"))
    assert spark_profile(profile_fields(shuffled, "pos")) == python_profile(objects)


def test_profile_of_many_fields_has_the_same_plan(spark):
    def plan(fields):
        objects = [{f"f{i}": i} for i in range(fields)]
        found = profile_fields(records_of(spark, objects, 4), "pos")
        assert found.count() == fields
        return found._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert plan(10) == plan(2000)


def test_no_records(spark):
    assert profile_fields(records_of(spark, [{}]).limit(0), "pos").collect() == []


@pytest.mark.parametrize("threshold,standard", [(0.5, {"a", "b"}), (0.6, set())])
def test_schema_threshold(spark, threshold, standard):
    profile = profile_fields(records_of(spark, SMALL), "pos")
    roles = {r.field: r.role for r in derive_schema(profile, threshold).collect()}
    assert {f for f in ("a", "b") if roles[f] == "standard"} == standard
    assert all(roles[f] == "standard" for f in C.PRIORITY_FIELDS)


def test_schema_limit(spark):
    schema = derive_schema(profile_fields(records_of(spark, SMALL), "pos"))
    assert [c.field for c in collect_columns(schema)] == [*C.PRIORITY_FIELDS, "a", "b"]
    with pytest.raises(ValueError, match="more than 16"):
        collect_columns(schema, limit=16)


def flat(spark, data):
    row = flatten_results(results_of(spark, [data])).select(F.to_json("fields").alias("j")).first()
    found = json.loads(row.j)
    assert found.pop("url_id") == "url_001" and found.pop("source_url") == "u1"
    return found


FLAT = [
    ({"candidate_fit": {"tier": "A"}},
     {"fit_tier": "A", "fit_summary": None, "fit_strengths": "", "fit_gaps": ""}),
    ({"candidate_fit": {"strengths": ["a", "b"], "gaps": "c"}},
     {"fit_tier": None, "fit_summary": None, "fit_strengths": "a, b", "fit_gaps": "c"}),
    ({"candidate_fit": {"strengths": None, "gaps": []}},
     {"fit_tier": None, "fit_summary": None, "fit_strengths": None, "fit_gaps": ""}),
    ({"is_overqualified": True}, {"is_overqualified": True, "overqualified_reasoning": None}),
    ({"is_overqualified": {"value": False, "reasoning": "r"}},
     {"is_overqualified": False, "overqualified_reasoning": "r"}),
    ({"payment_analysis": {"estimated_range_irr": "x"}},
     {"estimated_salary_irr": "x", "salary_reasoning": None}),
    ({"growth_potential": {"summary": "s"}}, {"growth_potential": {"summary": "s"}}),
    ({"standard_extraction": {"fit_tier": "Z", "q": 1}, "candidate_fit": {"tier": "A"}},
     {"fit_tier": "A", "q": 1, "fit_summary": None, "fit_strengths": "", "fit_gaps": ""}),
    ({"standard_extraction": {"url_id": "other"}}, {}),
    ({"other": 1}, {}),
]


@pytest.mark.parametrize("data,want", FLAT)
def test_flatten(spark, data, want):
    assert flat(spark, data) == want


def test_records_without_data(spark):
    results = results_of(spark, [None, {}, {"other": 1}])
    assert [r.url_id for r in flatten_results(results).collect()] == ["url_003"]


DATAS = [
    {"standard_extraction": {"job_title": "t", "salary_min": "100", "salary_max": "x",
                             "remote_work": "hybrid", "required_skills": ["a", "b"], "n": 1,
                             "ok_flag": "true", "m": [], "salary_note": "text"}},
    {"standard_extraction": {"remote_work": True, "required_skills": "plain", "n": 2.5,
                             "m": "s", "experience_years": 3, "misc_features": {"k": 1}}},
    {"standard_extraction": {f"z{i:02d}": i for i in range(12)}},
    {"standard_extraction": {"misc_features": "own", "wide": 12345678901234567890}},
    None,
]


def test_wide_table(spark):
    built = build_final_table(results_of(spark, DATAS), threshold=0.25)
    rows = {r.url_id: r for r in built.table.collect()}
    one, two, three, four = (rows[f"url_00{i}"] for i in (1, 2, 3, 4))
    assert (one.salary_min, one.salary_max, one.remote_work) == (100.0, None, None)
    assert (one.required_skills, two.required_skills) == ("a, b", "plain")
    assert (one.n, two.n, two.remote_work, two.experience_years) == (1.0, 2.5, True, 3.0)
    assert (one.ok_flag, one.m, two.m, one.salary_note) == (True, "", "s", "text")
    assert json.loads(two.misc_features) == {"k": 1}
    assert json.loads(four.misc_features) == {"misc_features": "own"}
    assert four.wide == "12345678901234567890"
    assert one.misc_features is None and len(rows) == 4

    built = build_final_table(results_of(spark, DATAS), threshold=0.5, misc_limit=10)
    rows = {r.url_id: r for r in built.table.collect()}
    assert list(json.loads(rows["url_003"].misc_features)) == [f"z{i:02d}" for i in range(10)]


def test_strict_compat(spark):
    table = build_final_table(results_of(spark, DATAS), strict_compat=True).table
    assert [r.salary_note for r in table.collect()] == [None] * 4


def test_wide_table_invariants(spark):
    results = results_of(spark, DATAS)
    built = build_final_table(results, threshold=0.3)
    roles = built.schema.collect()
    standard = {r.field for r in roles if r.role == "standard"}
    misc = {r.field for r in roles if r.role == "misc"}
    assert not standard & misc and set(C.PRIORITY_FIELDS) <= standard
    assert set(built.table.columns) == standard | {C.MISC_COLUMN}
    assert built.table.count() == 4
    for r in built.profile.collect():
        assert sum(r.types.values()) == r.non_null_count
    again = build_final_table(results.repartition(8), threshold=0.3)
    key = lambda r: r.url_id
    assert sorted(again.table.collect(), key=key) == sorted(built.table.collect(), key=key)


def test_jobs_keep_values_before_coercion(spark):
    built = build_final_table(results_of(spark, DATAS))
    jobs = unify_objects(built.records, built.columns).select(F.to_json("job").alias("j"))
    first = json.loads([r.j for r in jobs.collect()][0])
    assert first["salary_max"] == "x" and first["required_skills"] == ["a", "b"]
    assert first["currency"] is None and first[C.MISC_COLUMN] is None


def test_long_form_keeps_empty_records(spark):
    facts = field_facts(records_of(spark, [{}, {"a": None}]), "pos").orderBy("pos").collect()
    assert [(r.field, r.type, r.sample, r.starts_record) for r in facts] == [
        (None, None, None, True), ("a", None, None, True),
    ]


def test_coverage(spark):
    results = results_of(spark, [{"a": 1, "b": None}, {"a": 2}, None, {}, {"c": 1}, {"b": 1}])
    rows = field_coverage(results).collect()
    assert [(r.field, r["count"], r.percentage) for r in rows] == [
        ("a", 2, 50.0), ("b", 1, 25.0), ("c", 1, 25.0),
    ]
    assert distinct_fields(results).count() == 3


def test_projection_plan_has_no_shuffle(spark):
    records = records_of(spark, SMALL)
    columns = collect_columns(derive_schema(profile_fields(records, "pos")))
    plan = unify(spark.createDataFrame([], records.schema), columns)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_wide_columns_of_any_name(spark):
    names = ["a", "A", "b c", "d`e", "x.y", "f"]
    records = records_of(spark, [{n: [i, "t"] if n == "f" else i for i, n in enumerate(names)}, {}])
    columns = [WideColumn(n, "bigint" if n in "aA" else "double" if n == "x.y" else "string") for n in names]
    found = [tuple(r)[:-1] for r in unify(records, columns).collect()]
    assert sorted(found, key=str) == [(0, 1, "2", "3", 4.0, "5, t"), (None,) * 6]


def test_width_is_no_square(spark):
    """The projection looks no column up by name: the plan has one read of the record's entries."""
    columns = [WideColumn(f"f{i}", "string") for i in range(2000)]
    records = records_of(spark, [{f"f{i}": i for i in range(0, 2000, 2)}])
    wide = unify(records, columns)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") <= 2 and "try_element_at" not in plan
    row = wide.first()
    assert [row.f0, row.f1, row.f1998, row[C.MISC_COLUMN]] == ["0", None, "1998", None]


def test_largest_block_sorts_no_text(spark):
    rows = [("a", 1, " xx "), ("a", 2, "yyy"), ("a", 3, "zzz"), (None, 4, "q"), (None, 5, None), ("b", 6, None)]
    blocks = spark.createDataFrame(rows, "k string, at int, body string")
    best = largest_block(blocks, ["k"], "body", "at")
    assert sorted((r.k or "", r["at"]) for r in best.collect()) == [("", 4), ("a", 2), ("b", 6)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert best.columns == ["k", "at", "body"] and plan.count("Window [") == 1
    ranked = plan[plan.index("Window [") :]
    assert "body" not in ranked.split("\n")[0]
    assert blocks.limit(0).transform(lambda d: largest_block(d, ["k"], "body", "at")).count() == 0

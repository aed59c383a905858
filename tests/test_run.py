import json
import os
import time

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import text as X
from fieldloom.operators import scoring
from fieldloom.operators.incremental import first_per_key, latest, remaining, reusable
from fieldloom.plans.encoding import head, repair_csv
from fieldloom.plans.final_table import rebuild_from_files, save_final_table
from fieldloom.plans.run import Settings, run
from fieldloom.sources import readers as R
from fieldloom.sources import writers as W


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_url_list(spark, tmp_path):
    path = write(tmp_path / "urls.txt", "# c\n http://a \n\nhttp://b\n\t\nhttp://a\n#x\nhttp://c")
    rows = R.read_url_list(spark, path).orderBy("ordinal").collect()
    assert [(r.ordinal, r.url_id, r.url) for r in rows] == [
        (1, "url_001", "http://a"), (2, "url_002", "http://b"), (3, "url_003", "http://a"),
        (4, "url_004", "http://c"),
    ]
    assert rows[0].url_key == rows[2].url_key


def test_url_list_over_many_blocks(spark, tmp_path):
    lines = [f"http://h/{i:05d}" + ("\n#" if i % 3 else "") for i in range(3000)]
    write(tmp_path / "a.txt", "\n".join(lines[:2000]))
    write(tmp_path / "b.txt", "\n".join(lines[2000:]))
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "4096")
    try:
        rows = R.read_url_list(spark, str(tmp_path)).orderBy("ordinal").collect()
    finally:
        spark.conf.set(size, before)
    assert [r.ordinal for r in rows] == list(range(1, 3001))
    assert [r.url for r in rows] == [f"http://h/{i:05d}" for i in range(3000)]


def test_keyed_reuse(spark):
    work = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    done = spark.createDataFrame([(2, "a", 1), (2, "b", 2), (9, "c", 1)], "k int, v string, at int")
    assert sorted(r.k for r in remaining(work, done, ["k"]).collect()) == [1, 3]
    assert remaining(work, done, ["k"], force=True).count() == 4
    assert [r.v for r in latest(reusable(work, done, ["k"]), ["k"], "at").collect()] == ["b"]
    assert reusable(work, done, ["k"], force=True).count() == 0


def test_first_per_key_limits_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = first_per_key(rows, ["k"], F.asc("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


class Calls:
    """Counts calls in a file, as scoring runs in other processes."""

    def __init__(self, path):
        self.path = path

    def count(self):
        return os.path.getsize(self.path) if os.path.exists(self.path) else 0

    def opener(self):
        path = self.path

        def open_scorer():
            def score(system, prompt):
                with open(path, "ab") as f:
                    f.write(b"x")
                if "refuse" in prompt:
                    raise ValueError("refused")
                if "prose" in prompt:
                    return "no object here"
                data = {"Standard-Extraction": {"Job Title": prompt[-4:], "Salary Min": "5k"}}
                return f"Here: {json.dumps(data)}", {"tokens": len(prompt)}

            return score

        return open_scorer


@pytest.fixture
def site(spark, tmp_path):
    body = "text " * 30
    pages = [
        (1, "http://a", f"<article>{body} aaaa</article>"),
        (2, "http://b", f"<article>{body} refuse</article>"),
        (3, "http://c", f"<article>{body} prose</article>"),
        (4, "http://d", "<body></body>"),
        (5, "http://a", "<article>a later copy</article>"),
    ]
    urls = "\n".join(["http://a", "http://b", "http://c", "http://d", "http://a", "http://none"])
    return {
        "url_list": write(tmp_path / "urls.txt", urls),
        "template_path": write(tmp_path / "prompt.txt", " TEMPLATE \n"),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
        "base": str(tmp_path / "base"),
    }


def items(spark, site, run_id):
    rows = spark.read.parquet(f"{site['base']}/items/run_id={run_id}").orderBy("ordinal").collect()
    return [(r.url_id, r.error) for r in rows]


OUTCOMES = [
    ("url_001", None), ("url_002", "refused"), ("url_003", "No LLM response"),
    ("url_004", "No content extracted"), ("url_005", None), ("url_006", "No content extracted"),
]


def test_run_and_rerun(spark, site, tmp_path):
    calls = Calls(str(tmp_path / "calls"))
    quick = Settings(attempts=2, wait_factor=0, wait_range=(0, 0))
    report = run(spark, open_scorer=calls.opener(), settings=quick, run_id="r1", **site).first()
    assert (report.total_urls, report.successful, report.failed) == (6, 2, 4)
    assert items(spark, site, "r1") == OUTCOMES
    assert calls.count() == 4  # one good, one prose, one refused twice

    replies = spark.read.parquet(f"{site['base']}/replies")
    good = replies.filter("usable").first()
    assert good.prompt_length == len("TEMPLATE\n\nJob Advertisement Content:\n") + 30 * 5 + 4
    assert json.loads(good.usage) == {"tokens": good.prompt_length}
    assert spark.read.parquet(f"{site['base']}/quarantine").count() == 1
    failed = spark.read.json(f"{site['base']}/output/processing_report/failed_urls")
    assert sorted((r.url_id, r.error) for r in failed.collect()) == sorted(
        o for o in OUTCOMES if o[1]
    )
    table = spark.read.csv(f"{site['base']}/output/latest/analysis_csv", header=True).collect()
    assert sorted((r.url_id, r.salary_min) for r in table) == [
        ("url_001", "5000.0"), ("url_005", "5000.0"),
    ]

    run(spark, open_scorer=calls.opener(), settings=quick, run_id="r2", **site)
    assert items(spark, site, "r2") == OUTCOMES
    assert calls.count() == 7  # only what failed is tried again

    forced = Settings(attempts=1, force=True)
    run(spark, open_scorer=calls.opener(), settings=forced, run_id="r3", **site)
    assert items(spark, site, "r3") == OUTCOMES
    assert calls.count() == 10


def test_rerun_of_finished_work_scores_nothing(spark, site, tmp_path):
    calls = Calls(str(tmp_path / "calls"))
    site["url_list"] = write(tmp_path / "one.txt", "http://a")
    for run_id in ("r1", "r2"):
        run(spark, open_scorer=calls.opener(), run_id=run_id, **site)
        assert items(spark, site, run_id) == [("url_001", None)]
    assert calls.count() == 1


def test_run_resumes_from_stage_tables(spark, site, tmp_path):
    """Texts and replies without a result, as a lost run leaves them, are used again."""
    calls = Calls(str(tmp_path / "calls"))
    site["url_list"] = write(tmp_path / "one.txt", "http://a")
    run(spark, open_scorer=calls.opener(), run_id="r1", **site)
    left = {**site, "base": str(tmp_path / "left"), "pages": site["pages"].limit(0)}
    for stage in ("texts", "replies"):
        rows = spark.read.parquet(f"{site['base']}/{stage}/run_id=r1")
        rows.write.parquet(f"{left['base']}/{stage}/run_id=r1")
    run(spark, open_scorer=calls.opener(), run_id="r2", **left)
    assert items(spark, left, "r2") == [("url_001", None)]
    assert calls.count() == 1


def test_leftover_calls_are_not_made_again(spark, site, tmp_path):
    calls = Calls(str(tmp_path / "calls"))
    urls = site | {"url_list": write(tmp_path / "ok.txt", "http://a\nhttp://c")}
    quick = Settings(attempts=1)
    run(spark, open_scorer=calls.opener(), settings=quick, run_id="r1", **urls)
    assert calls.count() == 2
    left = urls | {"base": str(tmp_path / "left")}
    for stage in ("texts", "calls"):
        os.makedirs(f"{left['base']}/{stage}")
        os.rename(f"{urls['base']}/{stage}/run_id=r1", f"{left['base']}/{stage}/run_id=r1")
    report = run(spark, open_scorer=calls.opener(), settings=quick, run_id="r2", **left).first()
    assert (report.successful, calls.count()) == (1, 2)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_texts_shuffle_no_html(spark, site, tmp_path, limit, monkeypatch):
    from fieldloom.plans import run as plan

    monkeypatch.setattr(plan, "BROADCAST_BYTES", limit)
    seen, keep = [], W.append_run
    monkeypatch.setattr(W, "append_run", lambda rows, path, run_id: (seen.append((path, rows)), keep(rows, path, run_id))[1])
    work = spark.createDataFrame([("http://a", "ka"), ("http://d", "kd")], "url string, url_key string")
    texts = plan._texts(spark, work, site["pages"], str(tmp_path / "t"), "r", Settings()).collect()
    assert len(texts) == 1 and texts[0].content.endswith("aaaa")
    shown = seen[0][1]._jdf.queryExecution().optimizedPlan().toString()
    ranked = shown.index("Window")
    assert "html" in shown and "html" not in shown[:ranked]


def test_a_run_that_fails_midway_keeps_its_calls(spark, site, tmp_path):
    calls = Calls(str(tmp_path / "calls"))
    body = "text " * 30
    many = [(i, f"http://p/{i}", f"<article>{body} w{i:03d}</article>") for i in range(12)]
    given = site | {
        "url_list": write(tmp_path / "many.txt", "\n".join(u for _, u, _ in many)),
        "pages": spark.createDataFrame(many, "page_id long, url string, html string"),
    }
    made, opener = calls.path, calls.opener()

    def dying():
        score = opener()

        def call(system, prompt):
            if "w005" in prompt:
                # By then the other tasks have had time to end; this one takes its executor along.
                while not os.path.exists(made) or os.path.getsize(made) < 6:
                    time.sleep(0.1)
                time.sleep(5)
                os._exit(1)
            return score(system, prompt)

        return call

    settings = Settings(attempts=1, prompts_per_task=1)
    with pytest.raises(Exception, match="crashed"):
        run(spark, open_scorer=dying, settings=settings, run_id="r1", **given)
    stored = spark.read.schema("url_key string").parquet(f"{given['base']}/calls/run_id=r1").count()
    before = calls.count()
    assert 6 <= stored <= before < 12
    report = run(spark, open_scorer=opener, settings=settings, run_id="r2", **given).first()
    assert report.successful == 12 and calls.count() == before + 12 - stored


def test_score_keeps_rows_and_errors(spark):
    prompts = spark.range(40).select("id", F.col("id").cast("string").alias("prompt"))

    def open_scorer():
        seen = {}

        def score(system, prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if int(prompt) % 10 == 0 or (int(prompt) % 3 == 0 and seen[prompt] == 1):
                raise RuntimeError(f"bad {prompt}")
            return f" {system}:{prompt} "

        return score

    scored = scoring.score(
        prompts, open_scorer, ["id"], system_message="s", prompts_per_task=1, wait_factor=0,
        wait_range=(0, 0),
    ).collect()
    assert len(scored) == 40
    for r in scored:
        if r.id % 10 == 0:
            assert (r.raw_response, r.error, r.attempts) == (None, f"bad {r.id}", 3)
        else:
            assert (r.raw_response, r.error) == (f"s:{r.id}", None)
            assert r.attempts == (2 if r.id % 3 == 0 else 1)


def test_json_files_and_rebuild(spark, tmp_path):
    folder = tmp_path / "processed"
    folder.mkdir()
    good = {"url": "u", "url_id": "url_001", "timestamp": 1.5, "content_length": 7, "error": None,
            "data": {"standard_extraction": {"job_title": "مهندس", "n": 1}}}
    write(folder / "url_001.json", json.dumps(good, ensure_ascii=False, indent=2))
    write(folder / "url_002.json", json.dumps({"url": "v", "url_id": "url_002", "data": None}))
    write(folder / "url_003.json", '{"broken": ')
    write(folder / "url_004.json", '{"url_id": "x"} trailing')
    assert R.unreadable(R.read_json_files(spark, str(folder))).count() == 2
    assert R.read_result_files(spark, str(folder)).count() == 2
    row = R.read_results_with_data(spark, str(folder)).first()
    assert (row.url_id, row.timestamp, row.content_length) == ("url_001", 1.5, 7)
    os.utime(folder / "url_001.json", (2_000_000_000, 2_000_000_000))
    newest = R.latest_by_modification(
        R.readable(R.read_json_files(spark, str(folder))).withColumn("k", F.lit(1)), ["k"]
    )
    assert newest.first().file.endswith("url_001.json")

    out = str(tmp_path / "out")
    assert rebuild_from_files(spark, str(folder), out)
    parts = [p for p in (tmp_path / "out/latest/analysis_csv").iterdir() if p.suffix == ".csv"]
    assert parts and all(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in parts)
    table = spark.read.csv(f"{out}/latest/analysis_csv", header=True)
    assert table.columns[0] == "url_id" and table.first().job_title == "مهندس"
    job = json.loads(spark.read.text(f"{out}/latest/full_data/jobs").first().value)
    assert job["job_title"] == "مهندس" and job["n"] == 1 and job["company"] is None
    assert spark.read.json(f"{out}/latest/full_data/metadata").first().total_jobs == 1


def test_no_data_writes_nothing(spark, tmp_path):
    results = spark.createDataFrame(
        [(1, "url_001", "u", None)], "ordinal long, url_id string, url string, js string"
    ).withColumn("data", F.try_parse_json("js"))
    assert not save_final_table(results, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_csv_charsets(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    write(folder / "a.csv", "name,city\nعلی,تهران\n")
    write(folder / "b.csv", "\ufeffname,city\nرضا,شیراز\n")
    write(folder / "c.csv", "name,city\nسارا,کاشان\n", "cp1256")
    fixed = repair_csv(spark, str(folder), str(tmp_path / "fixed"), fallback="windows-1256")
    assert sorted((r.name, r.city) for r in fixed.collect()) == sorted(
        [("علی", "تهران"), ("رضا", "شیراز"), ("سارا", "کاشان")]
    )
    charsets = R.csv_charsets(spark, str(folder), "windows-1256").collect()
    assert sorted(r.charset for r in charsets) == ["UTF-8", "UTF-8", "windows-1256"]
    assert head(fixed).count() == 2


def test_json_rows_keep_text_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "a string, b string")
    W.write_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"a":"é","b":null}'


def test_stamp(spark):
    stamp = spark.range(1).select(X.run_stamp().alias("s")).first().s
    assert len(stamp) == 15 and stamp[8] == "_"


def test_csv_repair_keeps_every_value(spark, tmp_path):
    import csv

    folder = tmp_path / "mixed"
    folder.mkdir()
    files = {
        "a.csv": ("utf-8", [["id", "said"], ["1", 'say "hi, you" now'], ["2", "two\nlines, \"quoted\""], ["3", ""]]),
        "b.csv": ("utf-8-sig", [["id", "said"], ["4", "plain, comma"], ["5", '"']]),
        "c.csv": ("cp1256", [["نام", "id", "x"], ["سارا \"و\" علي", "6", "a,b"]]),
    }
    for name, (charset, rows) in files.items():
        with open(folder / name, "w", encoding=charset, newline="") as file:
            csv.writer(file, lineterminator="\n").writerows(rows)
    out = tmp_path / "fixed"
    fixed = repair_csv(spark, str(folder), str(out))
    for name, (_, rows) in files.items():
        found = []
        for part in sorted((out / f"source_file={name}").glob("part-*.csv")):
            assert part.read_bytes().startswith(b"\xef\xbb\xbf")
            with open(part, encoding="utf-8-sig", newline="") as file:
                own = list(csv.reader(file, escapechar=None))
            assert own[0] == rows[0]
            found += own[1:]
        assert sorted(found) == sorted([v if v else "" for v in row] for row in rows[1:])
    assert sorted((r.id, r.said) for r in fixed.collect() if r.said is not None) == sorted(
        (i, t) for name in ("a.csv", "b.csv") for i, t in files[name][1][1:] if t
    )
    again = repair_csv(spark, str(out / "source_file=a.csv"), str(tmp_path / "again"))
    assert sorted((r.id, r.said or "") for r in again.collect()) == sorted((i, t) for i, t in files["a.csv"][1][1:])


def test_one_template_or_an_error(spark, tmp_path):
    from fieldloom.operators.scoring import assemble_prompts

    for n in range(3):
        folder = tmp_path / f"t{n}"
        folder.mkdir()
        for i in range(n):
            write(folder / f"{i}.txt", f" T{i} ")
        texts = spark.createDataFrame([("c",)], "content string")
        given = spark.createDataFrame([(f"T{i}",) for i in range(n)], "template string")
        if n == 1:
            assert R.read_template(spark, str(folder)).first().template == "T0"
            assert assemble_prompts(texts, given, separator="|").first().prompt == "T0|c"
            continue
        with pytest.raises(Exception):
            R.read_template(spark, str(folder))
        with pytest.raises(Exception):
            assemble_prompts(texts, given).collect()

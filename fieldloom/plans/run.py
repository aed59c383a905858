"""The whole run: URL list and pages to results, table and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import constants as C
from fieldloom.functions import text as X
from fieldloom.operators import content as content_ops
from fieldloom.operators import reports, scoring
from fieldloom.operators.incremental import first_per_key, latest, remaining, reusable
from fieldloom.operators.outcomes import result_records
from fieldloom.operators.replies import parse_replies
from fieldloom.plans.final_table import save_final_table
from fieldloom.session import configure
from fieldloom.sources import readers as R
from fieldloom.sources import writers as W

# Largest list of URLs that is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024

TEXTS = (
    "url_key string, url string, strategy string, content string, usable boolean,"
    " written timestamp"
)
REPLIES = (
    "url_key string, model string, prompt_length int, raw_response string, usage string,"
    " attempts int, error string, response_length int, written timestamp,"
    " rung string, parsed_response variant, usable boolean"
)
CALLS = (
    "url_key string, model string, prompt_length int, raw_response string, usage string,"
    " attempts int, error string, response_length int, written timestamp"
)
RESULTS = (
    "url_key string, url string, timestamp double, content_length int, data variant,"
    " error string, usable boolean, written timestamp"
)


@dataclass
class Settings:
    """Options of a run."""

    model: str = "model"
    force: bool = False
    content_limit: int = C.MAX_CONTENT_LENGTH
    repair_json: bool = False
    # Prompts of one partition of the scoring job; free task slots bound the concurrent callers.
    # Every partition's calls are committed as it ends, so a run that is cut short loses at most
    # those of the tasks it was in.
    prompts_per_task: int = 200
    attempts: int = 3
    wait_factor: float = 2.0
    wait_range: tuple[float, float] = (1.0, 60.0)
    system_message: str = scoring.SYSTEM_MESSAGE
    separator: str = C.PROMPT_SEPARATOR


def _stored(spark: SparkSession, path: str, schema: str, run_id: str, s: Settings) -> DataFrame:
    """Usable rows of earlier runs; none when forced. The flag is a column of its own, so
    finding what is done reads no payload."""
    rows = W.earlier_runs(spark, path, schema, run_id).filter("usable")
    return rows.limit(0) if s.force else rows


def _texts(spark, work: DataFrame, pages: DataFrame, base: str, run_id: str, s: Settings):
    """``url_key, content``: the stored text when it is long enough, else from the first page of
    the URL.

    Text is extracted where a page is read, and the first page of a URL is found on the bounded
    texts, so no HTML is shuffled. A list of missing URLs that is small by its measured size is
    broadcast to pass over finished pages; a larger one is joined to the texts.
    """
    stored = _stored(spark, f"{base}/texts", TEXTS, run_id, s)
    missing = remaining(work, stored, ["url_key"]).select("url")
    size = missing.agg(F.sum(F.octet_length("url") + 16)).first()[0] or 0
    small = size <= BROADCAST_BYTES
    order = F.col("page_id") if "page_id" in pages.columns else F.lit(None).cast("long")
    narrow = pages.select("url", order.alias("page_id"), "html")
    if small:
        narrow = narrow.join(F.broadcast(missing), "url", "left_semi")
    texts = content_ops.extract_content(narrow, s.content_limit)
    first = first_per_key(texts, ["url"], F.asc_nulls_last("page_id"), F.xxhash64("content"))
    if not small:
        first = first.join(missing, "url", "left_semi")
    made = first.select(
        X.url_key(F.col("url")).alias("url_key"),
        "url",
        "strategy",
        "content",
        X.is_substantial(F.col("content")).alias("usable"),
        F.current_timestamp().alias("written"),
    )
    fresh = W.append_run(made, f"{base}/texts", run_id).filter("content <> ''")
    kept = latest(reusable(work, stored, ["url_key"]), ["url_key"], "written")
    columns = ["url_key", "content"]
    return fresh.select(*columns).unionByName(kept.select(*columns))


def _leftover_calls(spark, open_items: DataFrame, base: str, run_id: str, s: Settings) -> DataFrame:
    """Answered calls that a lost run committed but did not parse, the last one of each item."""
    calls = W.earlier_runs(spark, f"{base}/calls", CALLS, run_id).filter("raw_response is not null")
    parsed = W.earlier_runs(spark, f"{base}/replies", REPLIES, run_id).select("url_key", "run_id")
    left = calls.join(parsed, ["url_key", "run_id"], "left_anti")
    left = left.join(open_items.select("url_key"), "url_key", "left_semi").drop("run_id")
    return left.limit(0) if s.force else latest(left, ["url_key"], "written")


def _call(spark, items: DataFrame, template, open_scorer, base: str, run_id: str, s: Settings) -> DataFrame:
    """Call the caller's function for ``items``; each task commits its own calls."""
    path = f"{base}/calls"
    scored = scoring.score(
        items,
        open_scorer,
        ["url_key"],
        template=template,
        separator=s.separator,
        system_message=s.system_message,
        prompts_per_task=s.prompts_per_task,
        attempts=s.attempts,
        wait_factor=s.wait_factor,
        wait_range=s.wait_range,
    )
    calls = scored.select(
        "url_key",
        F.lit(s.model).alias("model"),
        "prompt_length",
        "raw_response",
        "usage",
        "attempts",
        "error",
        F.length("raw_response").alias("response_length"),
        F.current_timestamp().alias("written"),
    )
    W.append_by_task(calls, path, run_id)
    return spark.read.schema(CALLS).parquet(f"{path}/run_id={run_id}").drop("part")


def _replies(spark, texts, template, open_scorer, base: str, run_id: str, s: Settings):
    """``url_key, parsed_response, error``: the stored reply when it holds data, else the stored
    call of a lost run, else from the caller's function. Calls are committed before they are
    parsed, so no committed call is made twice."""
    stored = _stored(spark, f"{base}/replies", REPLIES, run_id, s)
    open_items = W.append_run(remaining(texts, stored, ["url_key"]), f"{base}/open", run_id)
    left = _leftover_calls(spark, open_items, base, run_id, s)
    called = _call(spark, remaining(open_items, left, ["url_key"]), template, open_scorer, base, run_id, s)
    called = called.unionByName(left)
    parsed = W.append_run(
        parse_replies(called, repair=s.repair_json)
        .withColumn("usable", F.col("reply_json").isNotNull())
        .drop("reply_json"),
        f"{base}/replies",
        run_id,
    )
    bad = parsed.filter("not usable and raw_response is not null")
    W.append_run(bad.drop("parsed_response", "usable"), f"{base}/quarantine", run_id)
    kept = latest(reusable(texts, stored, ["url_key"]), ["url_key"], "written")
    columns = ["url_key", "parsed_response", "error"]
    return parsed.select(*columns).unionByName(kept.select(*columns))


def process_items(
    spark: SparkSession,
    items: DataFrame,
    pages: DataFrame,
    template: DataFrame,
    open_scorer: Callable[[], scoring.Scorer],
    base: str,
    run_id: str,
    settings: Settings,
) -> DataFrame:
    """Result row for every item; finished work is reused unless forced.

    Items with the same URL share one piece of work and each keep a row. Every stage is a table
    under ``base``, so a run that was cut short is taken up by the next one.
    """
    spark = configure(spark)
    s = settings
    work = items.select("url").distinct().withColumn("url_key", X.url_key(F.col("url")))
    stored = _stored(spark, f"{base}/results", RESULTS, run_id, s)
    todo = W.append_run(remaining(work, stored, ["url_key"]), f"{base}/work", run_id)
    texts = _texts(spark, todo, pages, base, run_id, s)
    replies = _replies(spark, texts, template, open_scorer, base, run_id, s)
    lengths = texts.select("url_key", F.length("content").alias("content_length"))
    scored = todo.join(lengths, "url_key", "left").join(replies, "url_key", "left")
    made = (
        result_records(scored)
        .withColumn("usable", F.col("error").isNull())
        .withColumn("written", F.current_timestamp())
    )
    fresh = W.append_run(made, f"{base}/results", run_id)
    kept = latest(reusable(work, stored, ["url_key"]), ["url_key"], "written")
    columns = ["url_key", "timestamp", "content_length", "data", "error"]
    results = fresh.select(*columns).unionByName(kept.select(*columns))
    return W.append_run(items.join(results, "url_key", "left"), f"{base}/items", run_id)


def run(
    spark: SparkSession,
    url_list: str | list[str],
    template_path: str,
    pages: DataFrame,
    open_scorer: Callable[[], scoring.Scorer],
    base: str,
    settings: Settings | None = None,
    run_id: str | None = None,
    **table_options,
) -> DataFrame:
    """Process a URL list and write results, final table and report; gives the one-row report."""
    spark = configure(spark)
    s = settings or Settings()
    run_id = run_id or uuid.uuid4().hex
    items = R.read_url_list(spark, url_list)
    template = R.read_template(spark, template_path)
    results = process_items(spark, items, pages, template, open_scorer, base, run_id, s)
    good = reports.successful_items(results)
    if not good.isEmpty():
        save_final_table(good, f"{base}/output", **table_options)
    failed = reports.failed_items(results).select("url_id", "error")
    W.write_json(failed, f"{base}/output/processing_report/failed_urls")
    W.write_json(reports.run_report(results), f"{base}/output/processing_report/totals")
    return spark.read.json(f"{base}/output/processing_report/totals")

"""Raw replies to cleaned data, and the ones that hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import json as J
from fieldloom.functions import text as X


def parse_replies(replies: DataFrame, raw: str = "raw_response", repair: bool = False) -> DataFrame:
    """Add ``rung``, ``reply_json`` and ``parsed_response``: how an object was found in the
    reply, its text, and the cleaned data as VARIANT; the last two are null when there is none.

    Objects are cleaned to every level, however deep they nest.
    """
    found = replies.withColumn("_found", J.read_reply(F.col(raw), repair))
    text = F.col("_found.json")
    return found.select(
        *replies.columns,
        F.col("_found.rung").alias("rung"),
        text.alias("reply_json"),
        J.clean_json(text).alias("parsed_response"),
    )


def split_replies(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies with data, and the others for quarantine."""
    good = F.col("reply_json").isNotNull()
    return parsed.filter(good), parsed.filter(~good).drop("reply_json", "parsed_response")


def reply_metrics(replies: DataFrame, by: list[str]) -> DataFrame:
    """Prompt and reply lengths per group."""
    return replies.groupBy(*by).agg(
        F.count("*").alias("replies"),
        F.sum("prompt_length").alias("prompt_chars"),
        F.sum("response_length").alias("response_chars"),
        F.avg("prompt_length").alias("avg_prompt_length"),
        F.avg("response_length").alias("avg_response_length"),
        F.max("response_length").alias("max_response_length"),
    )


def with_lengths(replies: DataFrame, prompt: str = "prompt", raw: str = "raw_response") -> DataFrame:
    """Add prompt and reply length and the token estimate of the prompt."""
    return replies.select(
        "*",
        F.length(prompt).alias("prompt_length"),
        F.length(raw).alias("response_length"),
        X.estimate_tokens(F.col(prompt)).alias("prompt_tokens"),
    )

"""Prompts, and a caller's scoring function run over partitions."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import constants as C
from fieldloom.functions import text as X

SYSTEM_MESSAGE = "Extract structured information from the text and return one JSON object only."

Scorer = Callable[[str, str], "str | tuple[str, dict]"]


def assemble_prompts(
    texts: DataFrame,
    template: DataFrame,
    text: str = "content",
    separator: str = C.PROMPT_SEPARATOR,
) -> DataFrame:
    """Add ``prompt``: the one-row template, the separator, the text.

    Any other number of templates ends the job with an error.
    """
    several = F.raise_error(F.lit("exactly one template is needed")).cast("string")
    one = template.agg(F.when(F.count(F.lit(1)) == 1, F.first("template")).otherwise(several).alias("template"))
    prompt = F.concat("template", F.lit(separator), F.col(text))
    return texts.crossJoin(F.broadcast(one)).withColumn("prompt", prompt).drop("template")


def _attempt(score: Scorer, system: str, prompt: str, attempts: int, wait, sleep) -> tuple:
    for attempt in range(1, attempts + 1):
        try:
            reply = score(system, prompt)
            text, usage = reply if isinstance(reply, tuple) else (reply, None)
            return text, None if usage is None else json.dumps(usage), attempt, None
        except Exception as error:  # the row keeps the caller's error
            if attempt == attempts:
                return None, None, attempt, str(error) or type(error).__name__
            sleep(wait(attempt))
    return None, None, 0, "no attempt allowed"


def score(
    items: DataFrame,
    open_scorer: Callable[[], Scorer],
    keys: list[str],
    template: DataFrame | None = None,
    text: str = "content",
    separator: str = C.PROMPT_SEPARATOR,
    prompt: str = "prompt",
    system_message: str = SYSTEM_MESSAGE,
    prompts_per_task: int | None = None,
    attempts: int = 3,
    wait_factor: float = 2.0,
    wait_range: tuple[float, float] = (1.0, 60.0),
) -> DataFrame:
    """Run the caller's function on every prompt.

    Prompts are the ``prompt`` column, or with ``template`` (a one-row table) the template, the
    separator and the ``text`` column, put together where the function is called so that the
    template does not travel with every row. ``open_scorer`` is called once per partition, so
    connections are opened there; the function it returns takes the system and the human message
    and gives the reply, or the reply and a usage record. A failing row is tried again with
    growing pauses and then keeps its error. ``prompts_per_task`` deals the rows over partitions
    of about that size; a lost task repeats its own calls only, and the cluster's task slots bound
    how many callers run at once. Write the result before using it: reading it twice would call
    twice.
    """
    columns = [*keys, "prompt_length", "raw_response", "usage", "attempts", "error"]
    fields = [items.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    low, high = wait_range
    begin = None
    if template is not None:
        found = template.select("template").head(2)
        if len(found) != 1:
            raise ValueError("exactly one template is needed")
        begin = found[0].template + separator
    source = prompt if begin is None else text

    def wait(attempt: int) -> float:
        return min(high, max(low, wait_factor * 2 ** (attempt - 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = open_scorer()
        for batch in batches:
            prompts = [p if begin is None or p is None else begin + p for p in batch[source]]
            replies = [
                (None if p is None else len(p), *_attempt(scorer, system_message, p, attempts, wait, time.sleep))
                for p in prompts
            ]
            scored = pd.DataFrame(replies, columns=columns[len(keys):], dtype=object)
            yield pd.concat([batch[keys].reset_index(drop=True), scored], axis=1)

    spread = items.select(*keys, source)
    if prompts_per_task is not None:
        spread = spread.repartition(max(1, -(-spread.count() // prompts_per_task)))
    scored = spread.mapInPandas(
        run,
        f"{schema}, prompt_length int, raw_response string, usage string, attempts int, error string",
    )
    return scored.withColumn("raw_response", X.strip(F.col("raw_response")))

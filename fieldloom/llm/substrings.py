"""Repeated passages: a count-min sketch says which windows may repeat, and only those are compared.

A window of ``window`` words holds an anchor, its gram of ``gram`` words with the least hash. Equal
windows have equal anchors at equal places inside, so a window repeats only if its anchor does, and
sketching anchors (about one word in seven) gives a first upper estimate for every window; windows
that pass are sketched themselves, as a common line is the anchor of many windows that differ. The
exact pass sends windows that pass both, grouped by anchor, each distinct window once per task and
step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from fieldloom.llm.batches import add_columns, column, forget_tables, steps
from fieldloom.llm.sketch import MAX_BITS, may_repeat, merged_sketch, sketch_bits
from fieldloom.llm.stage import boxed, opened, parallel, whole_text
from fieldloom.llm.words import Words, runs_of, scan

WINDOW, GRAM = 20, 8
DEPTH = 2
# Windows that may repeat which a task compares among themselves before it sends them.
STEP_WINDOWS = 200_000
# Text bytes whose words a task holds as arrays at a time.
STEP_BYTES = (1 << 20) - 1
NULL_KEY = (1 << 63) - 1
_ASK = "anchor long, key long, body long, at int, mask int, windows binary"


def anchors(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, the word its anchor begins at, and the hash of every gram."""
    grams, left = runs_of(words, gram, seed=1)
    starts = np.flatnonzero(left >= window)
    span = window - gram + 1
    least = grams[starts].copy()
    for k in range(1, span):
        np.minimum(least, grams[starts + k], out=least)
    offset = np.zeros(len(starts), np.int64)
    for k in range(span - 1, -1, -1):
        offset[grams[starts + k] == least] = k
    return starts, starts + offset, grams


def _not_first(order_keys: tuple, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of equal windows, those after the least (key, start)."""
    order = np.lexsort((start, key, *order_keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for values in order_keys:
        v = values[order]
        new[1:] |= v[1:] != v[:-1]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.empty(len(order), bool)
    later[order] = (key[order] != key[head]) | (start[order] != start[head])
    return later


def _rows(anchor, key, body, at, mask, offsets, data: bytes) -> pa.RecordBatch:
    """Rows of the exchange; a row without windows is a finding, not a question."""
    n = len(key)
    windows = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor.view(np.int64)), pa.array(key), pa.array(body), pa.array(at.astype(np.int32)), pa.array(mask.astype(np.int32)), windows],
        names=["anchor", "key", "body", "at", "mask", "windows"],
    )


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``key, body, at, mask``: bit j of ``mask`` says that the window that begins at word
    ``at - (window - gram) + j`` also begins earlier. ``docs`` has ``_key, _body, _text``."""
    reach = window - gram
    if not 0 < gram <= window or reach > 30:
        raise ValueError("a gram must fit its window with at most 30 words beside it")
    volume = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = sketch_bits(volume // 40, MAX_BITS - DEPTH)
    window_bits = sketch_bits(volume // 20, MAX_BITS - DEPTH)

    def anchor_values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in steps([batch], "_text", STEP_BYTES):
            _, at, grams = anchors(scan(column(part, "_text"), False), window, gram)
            yield grams[np.unique(at)]

    sketch = merged_sketch(docs.select("_text"), anchor_values, bits, DEPTH)

    def likely(words: Words) -> tuple[np.ndarray, ...]:
        """Windows whose anchor may repeat: first word, anchor's word, anchor and window hash."""
        starts, at, grams = anchors(words, window, gram)
        own = may_repeat(grams[at], sketch.value, bits, DEPTH)
        starts, at = starts[own], at[own]
        return starts, at, grams[at], runs_of(words, window, seed=2)[0][starts]

    def window_values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in steps([batch], "_text", STEP_BYTES):
            yield likely(scan(column(part, "_text"), False))[3]

    window_sketch = merged_sketch(docs.select("_text"), window_values, window_bits, DEPTH)

    def questions(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        whole, anchor, key, body, at, j = (np.concatenate(x) for x in zip(*held, strict=True))
        later = _not_first((whole,), key, at - reach + j)
        bit = np.left_shift(1, j)
        for own, asks in ((later, False), (~later, True)):
            rows = np.flatnonzero(own)
            if not len(rows):
                continue
            rows = rows[np.lexsort((j[rows], at[rows], body[rows], key[rows]))]
            new = np.ones(len(rows), bool)
            new[1:] = (np.diff(at[rows]) != 0) | (np.diff(key[rows]) != 0) | (np.diff(body[rows]) != 0)
            # A repeated row would give a bit twice; its second question starts a row of its own.
            new[1:] |= np.diff(j[rows]) <= 0
            head = np.flatnonzero(new)
            mask = np.bitwise_or.reduceat(bit[rows], head)
            offsets = 8 * np.append(head, len(rows)) if asks else np.zeros(len(head) + 1, np.int64)
            data = whole[rows].tobytes() if asks else b""
            first = rows[head]
            # Findings only pass through, so they are dealt by their text, not by a common anchor.
            yield _rows(anchor[first] if asks else body[first], key[first], body[first], at[first], mask, offsets, data)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        held, size = [], 0
        for part in steps(batches, "_text", STEP_BYTES):
            words = scan(column(part, "_text"), False)
            starts, at, anchor, whole = likely(words)
            own = may_repeat(whole, window_sketch.value, window_bits, DEPTH)
            starts, at, anchor, whole = starts[own], at[own], anchor[own], whole[own]
            if len(starts):
                text = np.searchsorted(words.first, starts, "right") - 1
                key, body = (column(part, c).to_numpy(zero_copy_only=False)[text] for c in ("_key", "_body"))
                held.append((whole, anchor, key, body, at - words.first[text], starts - at + reach))
                size += len(starts)
            if size >= STEP_WINDOWS:
                yield from questions(held)
                held, size = [], 0
        if size:
            yield from questions(held)

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        anchor, key, body, at, mask = (table.column(i).to_numpy() for i in range(5))
        asked = pc.binary_length(table.column(5)).to_numpy() > 0
        given = np.where(asked, 0, mask)
        rows = np.flatnonzero(asked)
        if len(rows):
            own, j = np.nonzero(mask[rows, None] >> np.arange(reach + 1) & 1)
            own = rows[own]
            whole = np.frombuffer(b"".join(v for c in table.column(5).chunks for v in c.to_pylist()), "<u8")
            later = _not_first((whole, anchor[own]), key[own], at[own] - reach + j)
            np.bitwise_or.at(given, own[later], np.left_shift(1, j[later]).astype(given.dtype))
        found = given != 0
        return pa.RecordBatch.from_arrays(
            [pa.array(key[found]), pa.array(body[found]), pa.array(at[found]), pa.array(given[found])],
            names=["key", "body", "at", "mask"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = column(batch, "anchor").to_numpy()
            begin = 0
            if size and anchor[0] == held[-1].column(0)[-1].as_py():
                begin = int(np.searchsorted(anchor, anchor[0], "right"))
                held.append(batch.slice(0, begin))
                if begin == batch.num_rows:
                    continue
            if size:
                yield answer(held)
            last = int(np.searchsorted(anchor, anchor[-1], "left"))
            if last > begin:
                yield answer([batch.slice(begin, last - begin)])
            held, size = [batch.slice(max(last, begin))], 1
        if size:
            yield answer(held)

    return (
        docs.mapInArrow(ask, _ASK)
        .repartition(parallel(docs), "anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(compare, "key long, body long, at int, mask int")
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``.

    Removed is each word in a window of ``window`` words that also begins earlier: in a row with a
    smaller key (an integer; null counts as the largest), or in the same text further ahead.
    Windows are judged on the given texts. ``kept_text`` joins the other words by one space. Null
    and empty texts have no words; texts shorter than a window lose nothing. Rows that repeat
    another row's key are one document with it if the text is the same, so neither removes the
    other's words; of two texts under one key neither start is earlier than an equal one. The
    added columns replace columns of those names.
    """
    place = F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY))
    body = F.xxhash64(whole_text(text))
    narrow = docs.select(place.alias("_key"), body.alias("_body"), whole_text(text).alias("_text"))
    found = repeated_windows(narrow, window, gram)
    lists = found.groupBy("key", "body").agg(F.collect_list(F.struct("at", "mask")).alias("_found"))
    kept = docs.drop("n_words", "n_removed", "kept_text")
    taken = {"_given": key, "_text": text}
    rows = (
        boxed(kept, **taken)
        .withColumns({"_key": F.coalesce(F.col("_given").cast("long"), F.lit(NULL_KEY)), "_body": F.xxhash64(whole_text("_text"))})
        .join(lists.toDF("_of", "_of_body", "_found"), (F.col("_key") == F.col("_of")) & (F.col("_body") == F.col("_of_body")), "left")
        .select(*taken, "_rest", F.col("_found.at").alias("_at"), F.col("_found.mask").alias("_mask"))
    )
    added = [StructField("n_words", LongType(), False), StructField("n_removed", LongType(), False), StructField("kept_text", StringType(), False)]
    reach = window - gram

    def work():
        forget_tables()

        def act(part: pa.RecordBatch) -> list[pa.Array]:
            words = scan(column(part, "_text"), False)
            lists, masks = column(part, "_at"), column(part, "_mask")
            owner = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            at = lists.flatten().to_numpy().astype(np.int64) + words.first[owner]
            mask = masks.flatten().to_numpy()
            own, j = np.nonzero(mask[:, None] >> np.arange(reach + 1) & 1)
            start = at[own] - reach + j
            cover = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + window, -1)
            keep = np.cumsum(cover[:-1]) == 0
            total = np.diff(words.first)
            stay = np.diff(np.concatenate([[0], np.cumsum(keep)])[words.first])
            return [pa.array(total), pa.array(total - stay), pa.array([t.decode() for t in words.joined(keep)], pa.string())]

        return act

    return add_columns(rows, "_text", added, work).select(*opened(kept.columns, **taken), *[f.name for f in added])

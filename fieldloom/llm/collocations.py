"""Phrase collocations: phrases whose words occur together more often than their parts would tell.

1. Words are counted per language. A word of a language has a 64-bit id; that no two share one is
   checked on the table of all words (else ids are made with another key).
2. Two-word, then longer phrases are counted in counting quotient filters (``quotient``). A phrase
   can only be frequent if the two phrases without its first and last word are, so words and
   phrases that are not frequent are left out by a bitmap of those that are. The bitmap is at most
   32 MB: beyond some 10**8 frequent phrases it keeps ever more of the others, which costs shuffle
   and never changes a count.
3. Parts of frequent phrases are frequent, so scores come from joins of these small tables alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.batches import column, forget_tables, steps
from fieldloom.llm.quotient import count_grams, permute, shard_bits
from fieldloom.llm.sketch import may_repeat, merged_sketch, sketch_bits
from fieldloom.llm.stage import parallel, written
from fieldloom.llm.words import Words, mix, scan

# The characters that end a piece; white space that only parts words is space and tab.
BREAKS = b".,;:!?\n\v\f\r"
NO_LANGUAGE = "und"
# Longer words are hashed one by one: sums of powers modulo 2**64 collide on some very long ones.
LONG_WORD = 256
_RANK_SALTS = 16

_breaks = np.zeros(256, bool)
_breaks[list(BREAKS)] = True
_spaced = np.where(_breaks, 32, np.arange(256)).astype(np.uint8)


def scan_pieces(array: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of texts in lower case (A-Z), and a number per word that is equal within a piece."""
    if array.null_count:
        array = array.fill_null("")
    array = pa.concat_arrays([array])  # without offset
    wide = pa.types.is_large_string(array.type)
    bounds = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[: len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    spaced = pa.Array.from_buffers(array.type, len(array), [None, array.buffers()[1], pa.py_buffer(_spaced[data].tobytes())])
    words = scan(spaced, lower=True)
    own = data[bounds[0] : bounds[-1]] if len(array) else data[:0]
    ends = np.zeros(len(own) + 1, np.int64)
    np.cumsum(_breaks[own], out=ends[1:])
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    return words, ends[words.start] + doc  # both only grow, so equal sums mean the same piece


def _digest(data: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=seed.to_bytes(4, "little")).digest(), "little")


def word_ids(words: Words, languages: list[str], seed: int) -> np.ndarray:
    """64-bit ids of the words of texts in these languages."""
    hashes = words.hash.copy()
    odd = np.arange(len(hashes)) if seed else np.flatnonzero(words.end - words.start > LONG_WORD)
    for at in odd.tolist():
        hashes[at] = _digest(words.data[words.start[at] : words.end[at]].tobytes(), seed)
    known = {name: _digest(name.encode("utf-8", "surrogatepass"), seed) for name in set(languages)}
    salt = np.array([known[name] for name in languages], np.uint64)
    return mix(hashes ^ np.repeat(salt, np.diff(words.first)))


def _read(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, list[str]]]:
    """Words, pieces and ids of a batch, a bounded step at a time."""
    for part in steps([batch], "text"):
        words, pieces = scan_pieces(column(part, "text"))
        languages = column(part, "lang").to_pylist()
        yield words, pieces, word_ids(words, languages, seed), languages


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """Every distinct word of every language with its id and count: ``id, lang, word, n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in batches:
            for words, _, ids, languages in _read(batch, seed):
                found, first, n = np.unique(ids, return_index=True, return_counts=True)
                doc = np.searchsorted(words.first, first, side="right") - 1
                text = [words.data[a:b].tobytes() for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array([languages[d] for d in doc.tolist()], pa.string()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))],
                    names=["id", "lang", "word", "n"],
                )

    found = rows.mapInArrow(count, "id long, lang string, word string, n long")
    return found.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def _members(df: DataFrame, names: list[str], count: int) -> tuple[Broadcast, int]:
    """Broadcast bitmap of the frequent words or phrases, sized to their number."""
    bits = sketch_bits(2 * count)

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        ids = [column(batch, name).to_numpy(zero_copy_only=False).view(np.uint64) for name in names]
        # A cell is set when it is hit twice, so every member is given twice.
        yield np.repeat(permute(ids) if len(ids) > 1 else ids[0], 2)

    return merged_sketch(df.select(*names), values, bits, 1), bits


def frequent_phrases(rows: DataFrame, words: DataFrame, total: int, longest: int, least: int, seed: int) -> list[DataFrame]:
    """Tables of frequent words and phrases by length from 1: ``w1, .., f``."""
    tables = [words.where(F.col("n") >= least).select(F.col("id").alias("w1"), F.col("n").alias("f"))]
    for size in range(2, longest + 1):
        names = [f"w{i}" for i in range(1, size)]
        shared, bits = _members(tables[-1], names, tables[-1].count())
        tables.append(written(count_grams(rows, _grams(size, seed, shared, bits), size, shard_bits(total), least, parallel(rows))))
    return tables


def _grams(size: int, seed: int, shared: Broadcast, bits: int) -> Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]]:
    def grams(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for _, pieces, ids, _ in _read(batch, seed):
            n = len(ids) - size + 1
            if n <= 0:
                continue
            parts = [ids[k : len(ids) - size + 2 + k] for k in range(size - 1)]
            may = may_repeat(permute(parts) if size > 2 else parts[0], shared.value, bits, 1)
            kept = np.flatnonzero(may[:n] & may[1:] & (pieces[:n] == pieces[size - 1 :]))
            if len(kept):
                yield [ids[kept + k] for k in range(size)]

    return grams


def _named(df: DataFrame, names: list[str], count: str) -> DataFrame:
    """A table of phrases with other names for its ids and count."""
    return df.toDF(*names, count)


def _per_million(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts of up to 15 digits."""
    wide = [F.col(name).cast("decimal(15,0)") for name in (a, left, right)]
    over = wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over, wide[1] * wide[2])


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = 3,
    least: int = 10,
    top: int = 2000,
    inside: int = 50,
) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of every language:
    ``lang, rank, phrase, a, l, r, n, score``.

    A phrase lies within a piece and occurs ``least`` times or more. Cut after its first words it
    has the score ``floor(1000000 * a * a / (l * r))``; the lowest cut counts, of equal ones the
    first. Phrases inside a longer one that makes up ``inside`` percent of their occurrences are
    left out. Ties go by count, then by phrase in byte order.

    Null texts count as empty, a null language as ``und``. Rows are occurrences, so repeated rows
    count again; empty tables give none; other columns are not read, so none can clash.
    """
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    for seed in range(8):
        words = written(count_words(rows, seed))
        if words.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
            break
    else:
        raise ValueError("words of equal id with eight keys")
    total = words.agg(F.sum("n")).first()[0] or 0
    tables = frequent_phrases(rows, words, total, longest, least, seed)

    places = [f"w{i}" for i in range(1, longest + 1)]
    scored = []
    for size in range(2, longest + 1):
        own = places[:size]
        table = _named(tables[size - 1], own, "a")
        for k in range(1, size):
            left, right = _named(tables[k - 1], own[:k], f"l{k}"), _named(tables[size - k - 1], own[k:], f"r{k}")
            table = table.join(left, own[:k]).join(right, own[k:])
        for longer in range(size + 1, longest + 1):
            found = _named(tables[longer - 1], places[:longer], "f")
            windows = [F.struct(*(F.col(places[s + i]).alias(own[i]) for i in range(size))) for s in range(longer - size + 1)]
            most = found.select("f", F.explode(F.array(*windows)).alias("w")).groupBy("w").agg(F.max("f").alias("most")).select("w.*", "most")
            table = table.join(most, own, "left").where(F.coalesce(100 * F.col("most") < inside * F.col("a"), F.lit(True))).drop("most")
        cuts = [
            F.struct(_per_million("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
            for k in range(1, size)
        ]
        best = F.array_min(F.array(*cuts))
        ids = F.array(*own)
        scored.append(table.select(ids.alias("ids"), "a", best.alias("cut")))
    phrases = reduce(DataFrame.unionByName, scored).select("ids", "a", "cut.score", "cut.l", "cut.r")

    names = words.where(F.col("n") >= least).select(F.col("id"), "lang", "word")
    spelled = (
        phrases.select("*", F.posexplode("ids").alias("at", "id"))
        .join(names, "id")
        .groupBy("ids", "a", "l", "r", "score")
        .agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_RANK_SALTS))).orderBy(*order)
    some = spelled.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

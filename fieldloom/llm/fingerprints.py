"""Bottom-k sketches of word shingles, with column functions only.

A sketch is the sorted array of the ``k`` least distinct shingle hashes. It is complete where the
text has fewer; sketches of parts merge into the sketch of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.stage import SPACES, whole_text

K = 128
SHINGLE = 5
# Rows that share a group while each looks for its next, unless that makes more groups than this.
ROWS_PER_GROUP = 1024
MOST_GROUPS = 1 << 16
NULL_KEY = -(1 << 63)


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text in order; null counts as empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, n: int = SHINGLE) -> Column:
    """Hashes of runs of ``n`` words from the words' hashes; of all words where there are fewer.

    Beyond the end there are nulls, which the hash passes over. The array is bound to a variable,
    so that it is computed once wherever the optimizer puts the expression.
    """

    def runs(bound: Column) -> Column:
        every = F.transform(bound, lambda x, i: F.xxhash64(x, *[F.get(bound, i + k) for k in range(1, n)]))
        return F.slice(every, 1, F.greatest(F.least(F.lit(1), F.size(bound)), F.size(bound) - (n - 1)))

    return F.element_at(F.transform(F.array(hashes), runs), 1)


def least(hashes: Column, k: int = K) -> Column:
    """The sketch of an array of hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(one: Column, other: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return least(F.concat(one, other), k)


def resemblance(one: Column, other: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both have.

    Exact where both sketches are complete. Two empty texts resemble each other fully, an empty
    and another text not at all.
    """
    union = merged(one, other, k)
    both = F.size(F.array_intersect(F.array_intersect(union, one), other))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, from how far the k-th least hash lies in their range."""
    far = (F.element_at(sketch, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / far)


def containment(one: Column, other: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 for an empty first."""
    union = merged(one, other, k)
    shared = resemblance(one, other, k) * distinct_shingles(union, k)
    return F.when(F.size(one) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(one, k)))


def merge_sketches(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group of rows: each task sends at most ``k`` hashes of a group."""
    ranked = Window.partitionBy(*keys).orderBy("_h")
    rows = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    return (
        rows.withColumn("_r", F.row_number().over(ranked))
        .where(F.col("_r") <= k)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_h")).alias(sketch))
    )


def as_text(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "sketch", k: int = K, n: int = SHINGLE) -> DataFrame:
    """``docs`` with the sketch of every whole text, as an array of hashes. No shuffle.

    Null counts as empty; a text without words has an empty sketch. A column of that name is
    replaced.
    """
    return (
        docs.withColumn("_words", word_hashes(F.col(text)))
        .withColumn("_shingles", shingle_hashes(F.col("_words"), n))
        .withColumn(name, least(F.col("_shingles"), k))
        .drop("_words", "_shingles")
    )


def place_of(key: Column, text: Column) -> Column:
    """Text that sorts like ``(key, hash of the text)``: 16 hexadecimal digits each, null keys least."""

    def digits(number: Column) -> Column:
        return F.lpad(F.hex(number.bitwiseXOR(F.lit(NULL_KEY))), 16, "0")

    return F.concat(digits(F.coalesce(key.cast("long"), F.lit(NULL_KEY))), digits(F.xxhash64(text)))


def group_firsts(places: DataFrame, rows: int, least: int = ROWS_PER_GROUP, most: int = MOST_GROUPS) -> list[str]:
    """The first place of every group, downwards.

    Places are sorted in ranges that Spark cuts at sampled bounds, so keys may lie anyhow. Groups have
    at least ``least`` rows beside the last of a range, and so many more that about ``most`` do for
    the table; as many short texts reach the driver.
    """
    size = max(least, -(-rows // most))
    ranges = places.repartitionByRange(F.desc("_place")).withColumn("_range", F.spark_partition_id())
    down = Window.partitionBy("_range").orderBy(F.desc("_place"))
    firsts = ranges.withColumn("_rank", F.row_number().over(down)).where((F.col("_rank") - 1) % size == 0)
    return sorted({row["_place"] for row in firsts.select("_place").collect()}, reverse=True)


def group_at(place: Column, firsts: list[str]) -> Column:
    """Number of the group that holds a place, by halving a constant list."""
    bounds = F.split(F.lit(",".join(firsts)), ",")
    steps = [1 << k for k in reversed(range(len(firsts).bit_length()))]

    def halve(at: Column, step: Column) -> Column:
        further = (at + step <= len(firsts)) & (F.get(bounds, at + step - 1) >= place)
        return F.when(further, at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(step) for step in steps]), F.lit(0), halve) - 1


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, n: int = SHINGLE) -> DataFrame:
    """``docs(key, text)`` with ``sketch``, ``next_text`` and ``next_sketch`` of the next row down the keys.

    After the least key comes the largest; a lone row is its own next. Keys are integers, spread as
    they may be; null comes after all others, and rows with one key follow each other in a fixed order
    of their texts. Rows fall into groups that follow each other down the keys. Texts are shuffled
    once: by group, together with a copy of the first row of the group after. Only rows equal in key
    and text cannot be parted.
    """
    rows = docs.select(F.col(key), whole_text(text).alias(text)).withColumn("_place", place_of(F.col(key), F.col(text)))
    firsts = group_firsts(rows.select("_place"), docs.count()) or [""]
    placed = rows.withColumn("_own", group_at(F.col("_place"), firsts))
    before = F.pmod(F.col("_own") - 1, F.lit(len(firsts)))
    is_first = F.get(F.split(F.lit(",".join(firsts)), ","), F.col("_own")) == F.col("_place")
    own = F.struct(F.col("_own").alias("group"), F.lit(0).alias("copy"))
    places = F.when(is_first, F.array(own, F.struct(before.alias("group"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    dealt = placed.select(key, "_place", text, F.explode(places).alias("_at"))
    dealt = dealt.select(key, "_place", text, F.col("_at.group").alias("_group"), F.col("_at.copy").alias("_copy"))
    order = Window.partitionBy("_group").orderBy("_copy", F.desc("_place"))
    sketched = fingerprints(dealt.repartition("_group"), text, "sketch", k, n)
    return (
        sketched.withColumns({"next_text": F.lead(text).over(order), "next_sketch": F.lead("sketch").over(order)})
        .where("_copy = 0")
        .select(key, text, "sketch", "next_text", "next_sketch")
    )


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, n: int = SHINGLE) -> DataFrame:
    """Every row with its text's sketch, the edited text, and their likeness.

    The edited text has the last half of its code points (rounded down) replaced by the first as
    many, or all, of the next row's text. Adds ``edited, edited_sketch, near_edited, near_next``.
    """
    rows = with_next(docs, key, text, k, n)
    half = F.floor(F.char_length(text) / 2).cast("int")
    edited = F.concat(F.substring(F.col(text), F.lit(1), F.char_length(text) - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = fingerprints(rows.withColumn("edited", edited), "edited", "edited_sketch", k, n)
    return out.withColumns(
        {
            "near_edited": resemblance(F.col("sketch"), F.col("edited_sketch"), k),
            "near_next": resemblance(F.col("sketch"), F.col("next_sketch"), k),
        }
    )

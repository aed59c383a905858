"""Exact Jaccard links between documents' shingle sets, as connected components.

Size-aware heavy-light join. Equal sets become one. A set can only be linked if three quarters of
its shingles are in other sets, so those that cannot are put aside first, by counting which of half
the shingles are. What is left is joined exactly: shingles are ordered from rare
to frequent, and linked sets share one shingle among the first quarter of each, two with one place
more. Small sets are joined by their pairs of such shingles (subsets of fixed size two), large ones
and those that reach up to them by scanning the inverted list of each such shingle; the boundary is
where the counted cost of both is least.

Every list first compares its members with one of them only, the one with the fewest shingles that
no other set has; members found linked are one component, and where all are in one the list is
done. In the others, every pair across components that could still be linked is compared, so no
link between components is lost, and a group of n copies costs n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.batches import column, forget_tables, steps
from fieldloom.llm.components import components
from fieldloom.llm.repeats import KeySketch, repeating_keys
from fieldloom.llm.stage import discard, whole_text, written
from fieldloom.llm.words import scan, shingle_sets

SHINGLE = 5
# Sets linked: NUM * union <= DEN * intersection, that is a similarity of 0.75.
NUM, DEN = 3, 4
# Largest size tried as the boundary between small and large sets.
MAX_SMALL = 256
# Text bytes whose words a task holds as arrays at a time.
STEP_BYTES = (1 << 20) - 1
NULL_KEY = (1 << 63) - 1
# Shingles with hashes below are counted before the join.
HALF = np.uint64(1 << 63)


def _least_shared(size):
    """Shingles that a set of ``size`` must share with any set linked to it."""
    return -(-NUM * size // DEN)


def set_table(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``key, size, h1, h2`` of every row of ``docs(_key, _text)``, written; h1 and h2 identify the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for part in steps(batches, "_text", STEP_BYTES):
            sets = shingle_sets(scan(column(part, "_text"), True), n)
            yield pa.RecordBatch.from_arrays([column(part, "_key"), *_identity(sets)], names=["key", "size", "h1", "h2"])

    return written(docs.mapInArrow(run, "key long, size int, h1 long, h2 long"))


def _identity(sets: list[np.ndarray]) -> list[pa.Array]:
    """Sizes of sets and two sums of hashes that tell them apart."""
    h1, h2 = [], []
    with np.errstate(over="ignore"):
        for own in sets:
            h1.append(int(own.sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
            odd = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h2.append(int(odd.sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
    return [pa.array([len(own) for own in sets], pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]


def linkable(docs: DataFrame, least: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``key`` of the rows whose sets may be linked with another set, written.

    ``least(set, size)`` has one key for each set, so equal sets do not count for each other. Only
    the shingles in the lower half of all hashes are counted: of those a set has, all but the
    quarter of its size that a link may miss are in the other set.
    """
    given = KeySketch(least.select("set"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for batch in batches:
            for part in steps([given.among(batch, "_key")], "_text", STEP_BYTES):
                sets = shingle_sets(scan(column(part, "_text"), True), n)
                for key, own in zip(column(part, "_key").to_pylist(), sets, strict=True):
                    if len(own):
                        low = own[: np.searchsorted(own, HALF)]
                        yield key, len(low) - len(own) + _least_shared(len(own)), low << np.uint64(1)

    return repeating_keys(docs, rows, (least.agg(F.sum("size")).first()[0] or 0) // 2)


def found_sets(docs: DataFrame, keys: DataFrame, n: int = SHINGLE) -> DataFrame:
    """``set, size, tokens`` of the distinct sets that may be linked, written; ``keys`` are those of their rows.

    ``set`` is the least key with that set. Of rows that the sketch of keys lets pass, too, and of
    those with the same key, one with each set stays.
    """
    asked = KeySketch(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            for part in steps([asked.among(batch, "_key")], "_text", STEP_BYTES):
                sets = shingle_sets(scan(column(part, "_text"), True), n)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                rows = pa.array(np.arange(row, row + len(sets)))
                yield pa.RecordBatch.from_arrays(
                    [rows, column(part, "_key"), *_identity(sets), tokens], names=["row", "set", "size", "h1", "h2", "tokens"]
                )
                row += len(sets)

    table = written(docs.mapInArrow(run, "row long, set long, size int, h1 long, h2 long, tokens array<long>"))
    rows = table.where("size > 0")
    chosen = rows.groupBy("h1", "h2").agg(F.min(F.struct("set", "row"))["row"].alias("row"))
    surplus = written(table.select("row").join(chosen.select("row"), "row", "left_anti"))
    sets = written(table.join(surplus, "row", "left_anti").select("set", "size", "tokens"), release=True)
    discard(table, surplus)
    return sets


def prefixes(sets: DataFrame) -> DataFrame:
    """``set, size, alone, places, first``: the rarest shared shingles of every set that can be linked.

    ``alone`` shingles are in no other set. ``places`` of the others decide single lists; ``first`` holds one more, for pairs, where there is
    one. Each entry is (number of sets that have it, shingle).
    """
    rows = sets.select("set", "size", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = (
        rows.join(counts, "token")
        .groupBy("set", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    )
    alone = F.col("size") - F.size("shared")
    least = F.expr(f"cast(ceil({NUM} * size / {DEN}D) AS int)")
    places = F.greatest(F.lit(0), F.col("size") - least + 1 - alone)
    return written(
        shared.where(F.size("shared") >= least)
        .select("set", "size", alone.alias("alone"), places.alias("places"), F.slice("shared", 1, places + 1).alias("first"))
        .where("places > 0"),
        release=True,
    )


def small_boundary(firsts: DataFrame, largest: int = MAX_SMALL) -> int:
    """The size up to which joining by pairs costs least, from the counted rows of both ways.

    A shingle costs its row in a list, a pair of shingles its own row, and either one comparison
    with the head of its list. Sets near the boundary are in both, so that small and large sets
    meet.
    """
    single = 2 * F.col("places").cast("long")
    count = F.size("first").cast("long")
    table = (
        firsts.where(F.col("size") <= largest)
        .groupBy("size")
        .agg(F.sum(single).alias("single"), F.sum(count * (count - 1)).alias("pairs"))
        .collect()  # a row per size
    )
    single, pairs = np.zeros(largest + 1), np.zeros(largest + 1)
    for row in table:
        single[row["size"]], pairs[row["size"]] = row["single"], row["pairs"]
    lists, subsets = np.cumsum(single), np.cumsum(pairs)
    cost = [subsets[x] + lists[-1] - lists[(NUM * x - 1) // DEN if x else 0] for x in range(largest + 1)]
    return int(np.argmin(cost))


def postings(firsts: DataFrame, boundary: int) -> DataFrame:
    """``key, set, alone``: sets with a key in common are the candidates. Written."""
    tokens = F.transform("first", lambda x: x["token"])
    small = firsts.where(F.col("size") <= boundary).select("set", "alone", tokens.alias("t"))
    pairs = F.flatten(
        F.transform(
            "t",
            lambda x, i: F.transform(F.slice(F.col("t"), i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))), lambda y: F.xxhash64(F.lit("pair"), x, y)),
        )
    )
    by_pair = small.select(F.explode(pairs).alias("key"), "set", "alone")
    large = firsts.where(F.col("size") * DEN > NUM * boundary)
    by_list = large.select(F.explode(F.slice(tokens, 1, F.col("places"))).alias("key"), "set", "alone")
    return written(by_pair.union(by_list))


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets with ``both``, the shingles they share, and whether they are ``linked``."""
    one = sets.select(F.col("set").alias("a"), F.col("size").alias("_na"), F.col("tokens").alias("_ta"))
    two = sets.select(F.col("set").alias("b"), F.col("size").alias("_nb"), F.col("tokens").alias("_tb"))
    met = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("_ta", "_tb")))
    return met.select("a", "b", "both", (F.col("both") * (NUM + DEN) >= (F.col("_na") + F.col("_nb")) * NUM).alias("linked"))


def set_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between sets that connect all that are linked. Written.

    The sets of one list were all measured against its head; sets measured against the same one
    are a star.
    """
    firsts = prefixes(sets)
    rows = postings(firsts, small_boundary(firsts))
    heads = rows.groupBy("key").agg(F.min(F.struct("alone", "set")).alias("head"), F.min("set").alias("_a"), F.max("set").alias("_b")).where("_a < _b")
    tried = rows.join(heads.select("key", F.col("head.set").alias("b")), "key").where("set <> b").select(F.col("set").alias("a"), "b").distinct()
    tried = written(measured(tried, sets), release=True)
    discard(firsts, rows)
    links = tried.where("linked").select("a", "b")
    across = candidates_across(tried, components(links), sets)
    return links.union(written(measured(across, sets), release=True).where("linked").select("a", "b"))


def candidates_across(tried: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of one star in different components that may be linked.

    Two sets of a star share at most what both share with its centre and what either has beside it
    in common with any set of the star (``beside``). No set of the star is smaller than ``least``,
    so a set that has too few shingles in common with all of them together is linked to none; the
    others are compared across components if the same bound allows the pair.
    """
    points = tried.select(F.col("b").alias("star"), F.col("a").alias("set"), "both")
    points = points.join(label, points.set == label.node, "left").select("star", "set", "both", F.coalesce("component", "set").alias("part"))
    mixed = points.groupBy("star").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).where("_low < _high").select("star")
    own = sets.select("set", "size", "tokens")
    centre = sets.select(F.col("set").alias("star"), F.col("tokens").alias("_tokens"))
    rests = written(
        points.join(mixed, "star", "left_semi")
        .join(own, "set")
        .join(centre, "star")
        .select("star", "set", "part", "size", "both", F.array_except("tokens", "_tokens").alias("rest")),
        release=True,
    )
    spread = rests.select("star", "set", F.explode("rest").alias("token"))
    counts = spread.groupBy("star", "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    beside = spread.join(counts, ["star", "token"]).groupBy("star", "set").agg(F.count(F.lit(1)).cast("int").alias("beside"))
    smallest = rests.groupBy("star").agg(F.min("size").alias("least"))
    points = (
        rests.drop("rest")
        .join(beside, ["star", "set"], "left")
        .join(smallest, "star")
        .withColumn("beside", F.coalesce("beside", F.lit(0)))
        .where((F.col("both") + F.col("beside")) * (NUM + DEN) >= (F.col("size") + F.col("least")) * NUM)
    )
    parts = points.groupBy("star", "part").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("star").agg(F.max(F.struct("n", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    points = written(points.join(main.select("star", F.col("most.part").alias("main")), "star"), release=True)
    discard(rests)
    # Every set outside a star's main component against every set of another component.
    outside = points.where("part <> main").select("star", *[F.col(c).alias("_" + c) for c in ("set", "size", "both", "beside", "part")])
    at_most = F.least("both", "_both") + F.least("beside", "_beside")
    return (
        outside.join(points, "star")
        .where((F.col("_part") != F.col("part")) & (at_most * (NUM + DEN) >= (F.col("size") + F.col("_size")) * NUM))
        .select(F.greatest("_set", "set").alias("a"), F.least("_set", "set").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``docs``.

    A row's set holds the distinct ``n``-word shingles of its whole text, A-Z in lower case; a
    text with fewer words has its whole sequence as the one shingle, and a text without words
    (null, too) has none and is linked with nothing. Rows are linked when 4 * intersection >=
    3 * union; ``component_id`` is the least key reachable by links, the row's own included. Keys
    are integers; null keys count as the largest and stay null where nothing smaller is linked.
    Repeated rows have equal sets and so one component. Other columns are left out.
    """
    narrow = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("_key"), whole_text(text).alias("_text"))
    rows = set_table(narrow, n)
    least = written(rows.where("size > 0").groupBy("h1", "h2").agg(F.min("key").alias("set"), F.max("size").alias("size")), release=True)
    sets = found_sets(narrow, linkable(narrow, least, n), n)
    label = components(set_links(sets))
    discard(sets)
    named = least.join(label, least.set == label.node, "left").select("h1", "h2", F.coalesce("component", "set").alias("component"))
    out = rows.join(named, ["h1", "h2"], "left")
    component = F.when(F.col("size") == 0, F.col("key")).otherwise(F.col("component"))
    return out.select(
        F.nullif("key", F.lit(NULL_KEY)).alias(key),
        F.col("size").cast("long").alias("n_shingles"),
        F.nullif(component, F.lit(NULL_KEY)).alias("component_id"),
    )

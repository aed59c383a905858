"""Best-fit packing in partitions that lower bounds certify, with exchange where a gap is left."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldloom.llm.stage import written

# Pieces that one group packs, about.
GROUP_ROWS = 8192
# Bins of a group have numbers below this.
BIN_SPAN = 1 << 24
_WORK = ("_round", "_group", "_bin", "_offset", "_fill", "_bins", "_bound")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of every piece: longest first, each into the fullest bin that takes it.

    Open bins are kept by the space they have left, and a bit per amount of space tells the
    smallest that is enough.
    """
    bins = np.zeros(len(lengths), np.int64)
    places = np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, opened = 0, 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[at])
        enough = present >> length
        if enough:
            space = length + (enough & -enough).bit_length() - 1
            own = by_space[space].pop()
            if not by_space[space]:
                present ^= 1 << space
        else:
            space, own = capacity, opened
            opened += 1
        bins[at], places[at] = own, capacity - space
        left = space - length
        if left:
            if not by_space[left]:
                present |= 1 << left
            by_space[left].append(own)
    return bins, places


def bin_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing of ``counts[n]`` pieces of each length n needs at least.

    Found by families of dual feasible functions: each maps lengths so that whatever fits a bin still fits; the mapped sum is then a
    bound. Taken here: the lengths themselves; lengths with the small ones dropped and those that
    leave no room but for small ones rounded up, for every border; and rounding down to k-ths.
    """
    sizes = np.arange(capacity + 1)
    weight = counts * sizes
    many, total = np.cumsum(counts), np.cumsum(weight)
    best = -(-int(total[-1]) // capacity)
    small = np.arange(1, capacity // 2 + 1)
    large = many[-1] - many[capacity - small]
    middle = total[capacity - small] - total[small - 1]
    if len(small):
        best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 33):
        up = (k + 1) * sizes
        mapped = np.where(up % capacity == 0, sizes * k, up // capacity * capacity)
        best = max(best, -(-int((counts * mapped).sum()) // (k * capacity)))
    return best


def _packed(items: DataFrame, round_: int, groups: int, capacity: int) -> DataFrame:
    """Deal items over groups and pack each; the work columns say where every item lies."""
    own = [c for c in items.columns if c not in _WORK]
    dealt = items.select(
        *own,
        F.lit(round_).cast("long").alias("_round"),
        F.pmod(F.xxhash64(*[F.col(c) for c in own], F.lit(round_)), F.lit(groups)).cast("long").alias("_group"),
    )
    schema = StructType([*dealt.schema.fields, *(StructField(c, LongType(), False) for c in _WORK[2:])])

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy(np.int64)
        bins, places = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = bin_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return frame.assign(_bin=bins, _offset=places, _fill=filled[bins], _bins=len(filled), _bound=bound)

    return written(dealt.groupBy("_group").applyInPandas(fill, schema))


def pack(items: DataFrame, capacity: int = 4096, group_rows: int = GROUP_ROWS, rounds: int = 5) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    Pieces are dealt over groups of about ``group_rows``; each is packed best fit decreasing, and
    its bound tells whether it could have fewer bins by itself. While all bins together exceed the
    bound of the whole table, the groups exchange: the pieces of bins with space left, and all
    pieces of groups above their own bound, are dealt anew, over groups twice as large each round
    (sixteen times at most), and packed again; a round's result is taken if it saves bins.
    Every piece keeps its row, repeated rows too; all columns should be
    narrow, as they travel along. Null or impossible lengths raise an error. Columns named
    ``sequence_id`` or ``offset`` are replaced. An empty table gives no rows.
    """
    items = items.drop("sequence_id", "offset", *_WORK)
    counts = items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per length
    if any(r["length"] is None or not 1 <= r["length"] <= capacity for r in counts):
        raise ValueError(f"every length must be from 1 to {capacity}")
    rows = sum(r["n"] for r in counts)
    all_lengths = np.zeros(capacity + 1, np.int64)
    for r in counts:
        all_lengths[r["length"]] = r["n"]
    needed = bin_bound(all_lengths, capacity)
    packed = _packed(items, 0, max(1, -(-rows // group_rows)), capacity)
    for round_ in range(1, rounds):
        opens = F.col("_offset") == 0
        loose = (F.col("_fill") < capacity) | (F.col("_bins") > F.col("_bound"))
        bins, loose_bins, loose_rows = packed.agg(
            F.sum(opens.cast("long")), F.sum((loose & opens).cast("long")), F.sum(loose.cast("long"))
        ).first()
        if not loose_rows or bins == needed:
            break
        again = _packed(packed.where(loose), round_, max(1, -(-loose_rows // (group_rows << round_))), capacity)
        if again.where(opens).count() < loose_bins:
            packed = packed.where(~loose).unionByName(again)
    sequence = F.col("_round") * F.lit(1 << 56) + F.col("_group") * F.lit(BIN_SPAN) + F.col("_bin")
    return packed.select(*items.columns, sequence.alias("sequence_id"), F.col("_offset").alias("offset"))


"""Counting quotient filters over packed word-id n-grams: compact, sorted, mergeable and lossless.

An n-gram of 64-bit word ids is permuted so that its first 64 bits are spread evenly, whatever the
words are; the other ids stay as they are, and with them the first one can be had back. The spread
bits are cut in three: the shard (which task merges it), the quotient (its place in the filter)
and the remainder. A filter holds the length of the run of every quotient, the whole remainders in
order, and a counter each: one byte, or eight where that is too small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm.batches import forget_tables
from fieldloom.llm.words import _M1, _M2, mix

# n-grams a task gathers before it sends filters of them.
FILTER_GRAMS = 500_000
# n-grams of the whole input per shard, so that one shard's merged filter fits a task.
SHARD_GRAMS = 1_000_000
LEAST_SHARD_BITS, MOST_SHARD_BITS = 8, 24
_33 = np.uint64(33)
_TAIL = np.uint64(0x9FB21C651E98DF25)
_INVERSE_1 = np.uint64(pow(int(_M1), -1, 1 << 64))
_INVERSE_2 = np.uint64(pow(int(_M2), -1, 1 << 64))


def unmix(h: np.ndarray) -> np.ndarray:
    """The value that ``mix`` spreads to ``h``."""
    h = (h ^ (h >> _33)) * _INVERSE_2
    h = (h ^ (h >> _33)) * _INVERSE_1
    return h ^ (h >> _33)


def _tail(rest: list[np.ndarray]) -> np.ndarray:
    spread = mix(rest[-1] + _TAIL)
    for ids in rest[-2::-1]:
        spread = mix(ids ^ spread)
    return spread


def permute(ids: list[np.ndarray]) -> np.ndarray:
    """The spread first 64 bits of n-grams given as one array of ids per place; the rest stays."""
    return mix(ids[0] ^ _tail(ids[1:]))


def restore(spread: np.ndarray, rest: list[np.ndarray]) -> list[np.ndarray]:
    """The ids of permuted n-grams."""
    return [unmix(spread) ^ _tail(rest), *rest]


def combine(spread: np.ndarray, rest: list[np.ndarray], counts: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order with the sums of their counts (one each where None)."""
    order = np.argsort(spread, kind="stable")
    tie = spread[order]
    near = tie[1:] == tie[:-1]
    differ = np.zeros(len(near), bool)
    for ids in rest:
        own = ids[order]
        differ |= near & (own[1:] != own[:-1])
    if differ.any():  # different n-grams with the same 64 bits: order by all of them
        order = np.lexsort([*rest[::-1], spread])
        tie = spread[order]
        near = tie[1:] == tie[:-1]
        differ = np.zeros(len(near), bool)
        for ids in rest:
            own = ids[order]
            differ |= near & (own[1:] != own[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~near | differ])) if len(order) else np.zeros(0, np.int64)
    if counts is None:
        sums = np.diff(np.append(first, len(order)))
    else:
        sums = np.add.reduceat(counts[order], first) if len(order) else counts
    chosen = order[first]
    return spread[chosen], [ids[chosen] for ids in rest], sums.astype(np.int64)


def _short(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes, with 255 for those that do not fit, and these as 64-bit numbers."""
    return np.minimum(numbers, 255).astype(np.uint8), numbers[numbers >= 255].astype("<i8")


def encode(spread: np.ndarray, rest: list[np.ndarray], counts: np.ndarray, shard_bits: int) -> bytes:
    """One filter of sorted distinct n-grams that share their first ``shard_bits`` bits."""
    n = len(spread)
    places = max(0, n.bit_length() - 1)
    wide = 64 - shard_bits - places
    quotient = (spread << np.uint64(shard_bits)) >> np.uint64(64 - places) if places else np.zeros(n, np.uint64)
    remainder = spread & np.uint64((1 << wide) - 1)
    size = (wide + 7) // 8
    runs, long_runs = _short(np.bincount(quotient.astype(np.int64), minlength=1 << places))
    few, many = _short(counts)
    head = np.array([n, places, len(long_runs), len(many)], "<i8")
    packed = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :size]
    parts = [head, runs, long_runs, np.ascontiguousarray(packed), *(ids.astype("<u8") for ids in rest), few, many]
    return b"".join(part.tobytes() for part in parts)


def decode(data: bytes, shard: int, shard_bits: int, rest: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The n-grams and counts of a filter; ``rest`` is the number of ids beside the spread bits."""
    n, places, long_runs, many = np.frombuffer(data, "<i8", 4).tolist()
    at = 32

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    def whole(short: np.ndarray, large: int) -> np.ndarray:
        out = short.astype(np.int64)
        if large:
            out[short == 255] = take("<i8", large)
        return out

    wide = 64 - shard_bits - places
    size = (wide + 7) // 8
    runs = whole(take("u1", 1 << places), long_runs)
    packed = np.zeros((n, 8), np.uint8)
    packed[:, :size] = take("u1", n * size).reshape(n, size)
    spread = packed.reshape(-1).view("<u8").astype(np.uint64)
    if places:
        spread |= np.repeat(np.arange(1 << places, dtype=np.uint64), runs) << np.uint64(wide)
    if shard_bits:
        spread |= np.uint64(shard) << np.uint64(64 - shard_bits)
    others = [take("<u8", n).astype(np.uint64) for _ in range(rest)]
    return spread, others, whole(take("u1", n), many)


def shard_bits(grams: int) -> int:
    """Bits of the spread value that name a shard, from the number of n-grams in the whole input."""
    return min(MOST_SHARD_BITS, max(LEAST_SHARD_BITS, (grams // SHARD_GRAMS).bit_length()))


def count_grams(
    df: DataFrame,
    grams: Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]],
    size: int,
    bits: int,
    least: int,
    partitions: int,
) -> DataFrame:
    """Exact counts of n-grams of ``size`` ids that occur ``least`` times or more: ``w1, w2, .., f``.

    ``grams`` gives the n-grams of a batch as one array of ids per place. A task sends one filter
    per shard for the n-grams it has gathered, so a frequent n-gram is a counter per task and not
    a row per occurrence; a shard's filters are merged as they stream in, in order of the shards.
    """

    def part(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids = [np.concatenate(place) for place in zip(*held, strict=True)]
        held.clear()  # each n-gram is held once from here on
        spread, rest, counts = combine(permute(ids), ids[1:], None)
        of = spread >> np.uint64(64 - bits)
        edges = np.searchsorted(of, np.arange((1 << bits) + 1, dtype=np.uint64)) if bits < 16 else None
        if edges is None:
            starts = np.flatnonzero(np.diff(of, prepend=of[0] + np.uint64(1)))
            spans = list(zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True))
        else:
            spans = [(s, a, b) for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
        for begin in range(0, len(spans), 256):
            own = spans[begin : begin + 256]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, _, _ in own], pa.int32()),
                    pa.array([encode(spread[a:b], [x[a:b] for x in rest], counts[a:b], bits) for _, a, b in own], pa.binary()),
                ],
                names=["shard", "filter"],
            )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        held, n = [], 0
        for batch in batches:
            for ids in grams(batch):
                held.append(ids)
                n += len(ids[0])
                if n >= FILTER_GRAMS:
                    yield from part(held)
                    held, n = [], 0
        if n:
            yield from part(held)

    names = [f"w{i}" for i in range(1, size + 1)]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, n = None, [], 0

        def merged() -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
            if len(held) == 1:
                return held[0]
            return combine(
                np.concatenate([x[0] for x in held]),
                [np.concatenate(place) for place in zip(*(x[1] for x in held), strict=True)],
                np.concatenate([x[2] for x in held]),
            )

        def done() -> pa.RecordBatch:
            spread, rest, counts = merged()
            often = counts >= least
            ids = restore(spread[often], [x[often] for x in rest])
            return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in ids), pa.array(counts[often])], names=[*names, "f"])

        for batch in batches:
            for own, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != shard:
                    if held:
                        yield done()
                    shard, held, n = own, [], 0
                held.append(decode(data, own, bits, size - 1))
                n += len(held[-1][0])
                if n > 2 * FILTER_GRAMS and len(held) > 1:  # what repeats takes no room twice
                    held = [merged()]
                    n = len(held[0][0]) // 2
        if held:
            yield done()

    filters = df.mapInArrow(build, "shard int, filter binary")
    dealt = filters.repartition(partitions, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(merge, ", ".join(f"{name} long" for name in names) + ", f long")

"""Count-min sketches that tell, never wrongly for a repeated value, which values may be repeated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from fieldloom.llm.batches import forget_tables
from fieldloom.llm.stage import parallel
from fieldloom.llm.words import mix

# Values a task gathers before it sends a partial sketch.
PART_VALUES = 500_000
# A merged sketch has at most 2**28 cells, one bit each: 32 MB to the driver and to every executor.
# Beyond about 2**27 values it lets more unrepeated values pass; it never loses a repeated one.
MAX_BITS = 28
_BLOCK = 16  # cells of a sketch that are merged together, as a power of two


def sketch_bits(values: int, limit: int = MAX_BITS) -> int:
    """Cells, as a power of two, for so many values: about eight each, within the limit."""
    return min(limit, max(_BLOCK, (8 * max(1, values)).bit_length()))


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each 64-bit value in one row of the sketch."""
    spread = mix(values + np.uint64(row * 0x632BE59BD9B4E019 % (1 << 64))) if row else values
    return spread >> np.uint64(64 - bits)


def merged_sketch(
    df: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, depth: int
) -> Broadcast:
    """Broadcast bits: whether a cell was hit twice or more, for ``depth`` rows of 2**bits cells.

    ``values`` gives the 64-bit values of a batch; those in one array count once each. Every task
    sends the cells it hit in blocks, those hit twice marked; blocks are merged as they stream in.
    """

    def part(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        joined = np.concatenate(hashes)
        for row in range(depth):
            hit, counts = np.unique(cells(joined, row, bits), return_counts=True)
            blocks = (hit >> np.uint64(_BLOCK)).astype(np.int64)
            edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
            low = (hit & np.uint64((1 << _BLOCK) - 1)).astype("<u2")
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((blocks[edges[:-1]] + (row << (bits - _BLOCK))).astype("int32")),
                    pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([low[a:b][counts[a:b] > 1].tobytes() for a, b in spans], pa.binary()),
                ],
                names=["block", "hit", "twice"],
            )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        held, size = [], 0
        for batch in batches:
            for array in values(batch):
                held.append(array)
                size += len(array)
                if size >= PART_VALUES:
                    yield from part(held)
                    held, size = [], 0
        if size:
            yield from part(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts = None, None

        def done() -> pa.RecordBatch:
            full = np.packbits(counts > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([full], pa.binary())], names=["block", "full"])

        for batch in batches:
            for own, hit, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != block:
                    if block is not None:
                        yield done()
                    block, counts = own, np.zeros(1 << _BLOCK, np.uint8)
                at = np.frombuffer(hit, "<u2")
                counts[at] = np.minimum(counts[at], 1) + 1
                counts[np.frombuffer(twice, "<u2")] = 2
        if block is not None:
            yield done()

    sent = df.mapInArrow(parts, "block int, hit binary, twice binary")
    blocks = (
        sent.repartition(parallel(df), "block")
        .sortWithinPartitions("block")
        .mapInArrow(merge, "block int, full binary")
        .collect()
    )
    size = 1 << (_BLOCK - 3)
    whole = bytearray(depth * (1 << (bits - 3)))
    for row in blocks:
        whole[row.block * size : (row.block + 1) * size] = row.full
    return df.sparkSession.sparkContext.broadcast(bytes(whole))


def may_repeat(values: np.ndarray, sketch: bytes, bits: int, depth: int) -> np.ndarray:
    """Which values may be repeated: all of their cells were hit twice."""
    data = np.frombuffer(sketch, np.uint8)
    out = np.ones(len(values), bool)
    for row in range(depth):
        at = cells(values, row, bits) + np.uint64(row << bits)
        out &= (data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out

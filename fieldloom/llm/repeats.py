"""Which rows have enough of their values in other rows, too: counted exactly, never sending more than the values.

A task sends the values of a run of its rows (a part) in order, dealt into blocks by their first
bits, with six bytes for each: the next 32 bits, and which row of the part has it. A value that
several rows of a part have is counted there and sent once. The task of a block sees which values
come twice and answers every part with the rows that have them; answers are added up by part.
Different values are taken for equal only if block and 32 bits agree, which lets rows pass that
should not, never the reverse. Nothing is gathered or broadcast, so no size of input fills it up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame

from fieldloom.llm.batches import column, forget_tables
from fieldloom.llm.sketch import MAX_BITS, may_repeat, merged_sketch, sketch_bits
from fieldloom.llm.stage import parallel, written
from fieldloom.llm.words import mix

# Values a task gathers before it sends them, and rows at most: SEVERAL stands for more than one row.
PART_VALUES = 500_000
SEVERAL = (1 << 16) - 1
# Values of the whole input per block, so that one block fits a task.
BLOCK_VALUES = 1_000_000
LEAST_BLOCK_BITS, MOST_BLOCK_BITS = 11, 24
# Bytes of answers a task holds before it sends them.
ANSWER_BYTES = 8 << 20
# Rows of a sketch of keys: of those not in it, one in 8**DEPTH passes.
DEPTH = 3


def block_bits(values: int, tasks: int) -> int:
    """Bits that name a block, for so many values; every task has a few blocks."""
    return min(MOST_BLOCK_BITS, max(LEAST_BLOCK_BITS, (values // BLOCK_VALUES).bit_length(), (4 * tasks).bit_length()))


def repeating_keys(
    df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, int, np.ndarray]]], values: int
) -> DataFrame:
    """``key`` of the rows that have ``need`` values or more in common with other rows. Written.

    ``rows`` gives key, need and the distinct values (64 bits, evenly spread) of each row of a
    task; ``values`` is about how many there are in all.
    """
    tasks = parallel(df)
    bits = block_bits(values, tasks)

    def part(held: list[tuple[int, int, np.ndarray]], task: int, nth: int) -> pa.RecordBatch:
        own = np.concatenate([x[2] for x in held])
        place = np.repeat(np.arange(len(held), dtype="<u2"), [len(x[2]) for x in held])
        order = np.argsort(own)
        own, place = own[order], place[order]
        same = own[1:] == own[:-1]
        often = np.zeros(len(own), bool)
        often[1:] |= same
        often[:-1] |= same
        need = np.array([x[1] for x in held]) - np.bincount(place[often], minlength=len(held))
        place[often] = SEVERAL
        first = np.ones(len(own), bool)
        first[1:] = ~same
        own, place = own[first], place[first]
        blocks = (own >> np.uint64(64 - bits)).astype(np.int64)
        rest = (own >> np.uint64(32 - bits)).astype("<u4")
        edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        # The part's rows themselves go the same way, under blocks below zero that spread them.
        about = np.array([x[0] for x in held], "<i8").tobytes() + need.astype("<i8").tobytes()
        names = [*blocks[edges[:-1]].tolist(), -1 - (task * 8191 + nth) % (1 << 30)]
        data = [*(rest[a:b].tobytes() + place[a:b].tobytes() for a, b in spans), about]
        number = pa.array(np.full(len(names), (task << 33) + nth))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), number, pa.array(data, pa.binary())], names=["block", "part", "data"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        held, size, nth = [], 0, 0
        for row in rows(batches):
            held.append(row)
            size += len(row[2])
            if size >= PART_VALUES or len(held) == SEVERAL:
                yield part(held, task, nth)
                held, size, nth = [], 0, nth + 1
        if held:
            yield part(held, task, nth)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], []
        answers, size = {}, 0

        def done() -> int:
            rest = np.concatenate([np.frombuffer(x, "<u4", len(x) // 6) for x in held])
            place = np.concatenate([np.frombuffer(x, "<u2", len(x) // 6, len(x) // 6 * 4) for x in held])
            order = np.argsort(rest)
            same = rest[order[1:]] == rest[order[:-1]]
            often = np.zeros(len(rest), bool)
            often[order[1:][same]] = True
            often[order[:-1][same]] = True
            often &= place != SEVERAL
            ends = np.cumsum([0, *(len(x) // 6 for x in held)])
            ends = (2 * np.concatenate([[0], np.cumsum(often)])[ends]).tolist()
            found = place[often].tobytes()
            for own, a, b in zip(parts, ends[:-1], ends[1:], strict=True):
                if b > a:
                    answers.setdefault(own, []).append(found[a:b])
            return len(found)

        def sent(kind: int, data: dict[int, bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(data), pa.int64()), pa.array([kind] * len(data), pa.int32()), pa.array(list(data.values()), pa.binary())],
                names=["part", "kind", "data"],
            )

        for batch in batches:
            about = {}
            for name, own, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name < 0:
                    about[own] = data
                    continue
                if name != block and held:
                    size += done()
                    parts, held = [], []
                    if size > ANSWER_BYTES:
                        yield sent(1, {k: b"".join(v) for k, v in answers.items()})
                        answers, size = {}, 0
                block = name
                parts.append(own)
                held.append(data)
            if about:
                yield sent(0, about)
        if held:
            done()
        if answers:
            yield sent(1, {k: b"".join(v) for k, v in answers.items()})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, about, places = None, b"", []

        def done() -> pa.RecordBatch:
            keys, need = np.frombuffer(about, "<i8").reshape(2, -1)
            counts = np.bincount(np.frombuffer(b"".join(places), "<u2"), minlength=len(keys))
            return pa.RecordBatch.from_arrays([pa.array(keys[counts >= need])], names=["key"])

        for batch in batches:
            for own, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != part:
                    if part is not None:
                        yield done()
                    part, about, places = own, b"", []
                if kind:
                    places.append(data)
                else:
                    about = data
        if part is not None:
            yield done()

    blocks = df.mapInArrow(send, "block int, part long, data binary").repartition(tasks, "block").sortWithinPartitions("block")
    answers = blocks.mapInArrow(answer, "part long, kind int, data binary")
    parts = answers.repartition(tasks, "part").sortWithinPartitions("part", "kind")
    return written(parts.mapInArrow(decide, "key long"), release=True)


class KeySketch:
    """A broadcast sketch of keys: ``among`` tells which may be among them, never no for one that is."""

    def __init__(self, keys: DataFrame):
        """``keys`` has one column of longs."""

        def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            yield np.repeat(self.spread(batch.column(0)), 2)

        self.bits = sketch_bits(keys.count(), MAX_BITS - 2)
        self.sketch: Broadcast = merged_sketch(keys, values, self.bits, DEPTH)

    @staticmethod
    def spread(keys: pa.Array) -> np.ndarray:
        """Keys as evenly spread values."""
        with np.errstate(over="ignore"):
            return mix(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    def among(self, batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
        """The rows of a batch whose key may be among them."""
        return batch.filter(pa.array(may_repeat(self.spread(column(batch, name)), self.sketch.value, self.bits, DEPTH)))

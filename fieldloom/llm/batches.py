"""Arrow batches cut by bytes, and tables of distinct text chunks with a bound on their size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

# Text bytes a task works on at a time (a longer single text goes alone).
STEP_BYTES = 4 << 20
# Distinct chunks a Python worker remembers before it starts afresh.
TABLE_LIMIT = 1_000_000


def steps(batches: Iterable[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts hold about ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        begin, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_pylist()
        for at, size in enumerate(sizes):
            if at > begin and held + size > limit:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += size
        yield batch.slice(begin)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column of that name."""
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column, null as the empty text."""
    return [value or "" for value in column(batch, name).to_pylist()]


def add_columns(
    df: DataFrame,
    text: str,
    added: Sequence[StructField],
    work: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """``df`` with columns computed from its texts in one Arrow pass, a bounded step at a time.

    ``work`` is called once per task and gives a function from rows to the arrays of ``added``.
    Columns of ``df`` with the name of an added one are replaced.
    """
    names = {field.name.lower() for field in added}
    kept = [field for field in df.schema.fields if field.name.lower() not in names]
    schema = StructType([*kept, *added])
    labels = [field.name for field in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = work()
        for part in steps(batches, text):
            arrays = act(part)
            yield pa.RecordBatch.from_arrays([column(part, f.name) for f in kept] + arrays, names=labels)

    return df.mapInArrow(run, schema)


class ChunkTable(dict):
    """Distinct chunk -> its bytes, for chunks whose treatment does not depend on their place.

    ``make`` treats many distinct chunks at once. The table is emptied before it would pass
    ``limit`` entries, so memory stays bounded; a chunk met again is made again, with the same value.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int = TABLE_LIMIT):
        super().__init__()
        self.make, self.limit = make, limit

    def learn(self, chunks: Iterable[str]) -> None:
        """Make entries for the chunks that have none; all of ``chunks`` are present afterwards."""
        distinct = set(chunks)
        unseen = distinct.difference(self)
        if len(self) + len(unseen) > self.limit:
            self.clear()
            unseen = distinct
        new = list(unseen)
        if new:
            self.update(zip(new, self.make(new), strict=True))


_kept: dict[object, ChunkTable] = {}


def forget_tables() -> None:
    """Give the memory of kept tables back; operators that have none call it as a task begins."""
    _kept.clear()


def kept_table(key: object, build: Callable[[], ChunkTable]) -> ChunkTable:
    """The table under ``key`` in this Python worker, which runs many tasks in turn."""
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]

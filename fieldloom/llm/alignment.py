"""Alignment of two tokenizers' tokens of the same texts, and how often their ids are linked.

1. A text is cut into units before which both tokenizers always cut: a space or line break between
   other characters, with what follows. Each distinct unit is tokenized and aligned once per
   Python worker, many units in one call; the bytes of every call are compared with its text, and
   a text with a unit that fails is treated whole.
2. The identity map gives for every id of A the id of B with the same bytes. Groups of one token
   each that follow the map are counted in vectors as long as A's vocabulary, which merge to at
   most that many rows; only the pairs of the other groups are shuffled.
3. Counts go back to documents the same way: the vectors are broadcast (their size is the
   vocabulary's), the irregular pairs of documents are joined with their counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from fieldloom.llm.batches import column, forget_tables, kept_table, steps, texts
from fieldloom.llm.pieces import MARK
from fieldloom.llm.stage import written
from fieldloom.llm.wordpieces import byte_letters

# Distinct units a Python worker remembers before it starts afresh, and units tokenized in a call.
UNIT_LIMIT = 500_000
CALL_UNITS = 2_000

_odd = re.compile(r"\s\s").search
_cuts = re.compile(r"(?<=\S)(?=[ \n]\S)").split
_ends_well = re.compile(r"[ \n]\S(.*\S)?", re.DOTALL).fullmatch


class TokenPair:
    """Two tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in byte_of for c in token)
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        count = self.b.get_piece_size()
        self.bytes_b = [self._piece_bytes(i) for i in range(count)]
        # Of several ids with the same bytes the first that is no byte piece.
        own: dict[bytes, int] = {}
        for i in sorted(range(count), key=lambda i: (self.b.is_byte(i), i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                own.setdefault(self.bytes_b[i], i)
        self.identity = np.array([own.get(data, -1) for data in self.bytes_a], np.int64)
        self.length_a = np.array([len(data) for data in self.bytes_a], np.int64)
        self.length_b = np.array([len(data) for data in self.bytes_b], np.int64)
        self.name_a = [str(i) for i in range(len(self.bytes_a))]
        self.name_b = [str(i) for i in range(count)]
        self.by_unit = self._cuts_a(path_a) and self._cuts_b()

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def _cuts_a(self, path: str) -> bool:
        """Whether A always cuts before a space or line break that stands alone."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec.get("pre_tokenizer") or {}
        return spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")

    def _cuts_b(self) -> bool:
        """Whether B does: no piece goes on to a marker or over a line break, and texts are kept."""
        spaced = [data for i, data in enumerate(self.bytes_b) if not self.b.is_byte(i)]
        kept = b"".join(self.bytes_b[i] for i in self.b.encode("a  b\nc ")) == b" a  b\nc "
        return kept and all(b" " not in data.lstrip(b" ") and b"\n" not in data for data in spaced)

    def align(self, text: str, ends: np.ndarray) -> Aligned | None:
        """Groups of a text that begins with a space; None where the bytes of either side differ
        from the text's or a byte offset of ``ends`` is no end of a group."""
        data = text.encode()
        ids_a, ids_b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != data or b"".join(map(self.bytes_b.__getitem__, ids_b)) != data:
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        unit_ends = np.searchsorted(common, ends)
        if len(ends) and (unit_ends[-1] >= len(common) or (common[unit_ends] != ends).any()):
            return None
        last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        names_a = list(map(self.name_a.__getitem__, ids_a))
        names_b = list(map(self.name_b.__getitem__, ids_b))
        groups = [
            f"{names_a[i]}|{names_b[j]}" if m == 1 and n == 1 else f"{','.join(names_a[i - m + 1 : i + 1])}|{','.join(names_b[j - n + 1 : j + 1])}"
            for i, j, m, n in zip(last_a.tolist(), last_b.tolist(), size_a.tolist(), size_b.tolist(), strict=True)
        ]
        link_a, link_b = a[last_a], b[last_b]
        regular = (size_a == 1) & (size_b == 1) & (self.identity[link_a] == link_b)
        return Aligned(groups, size_a, size_b, link_a, link_b, regular, unit_ends + 1)


class Aligned:
    """Groups in order: their texts, numbers of tokens, last ids, and whether they follow the
    identity map; ``stops`` is the number of groups up to the end of every unit."""

    def __init__(self, groups, size_a, size_b, link_a, link_b, regular, stops):
        self.groups, self.size_a, self.size_b = groups, size_a, size_b
        self.link_a, self.link_b, self.regular, self.stops = link_a, link_b, regular, stops


def units_of(text: str) -> list[str]:
    """Units of a text as keys: without the space before them, except for a first unit that begins
    with white space of the text."""
    if not _odd(text) and not text[0].isspace() and not text[-1].isspace():
        return text.replace("\n", " \n").split(" ") if "\n" in text else text.split(" ")
    first, *rest = _cuts(" " + text)
    return [first if first[1:2].isspace() else first[1:], *(unit[1:] if unit[0] == " " else unit for unit in rest)]


def _unit(key: str) -> str:
    return key if key[0] in " \n" else " " + key


class UnitTable:
    """Distinct units of a worker: their number, and by number all that documents add up."""

    def __init__(self, pair: TokenPair, limit: int = UNIT_LIMIT):
        self.pair, self.limit = pair, limit
        self._empty()

    def _empty(self) -> None:
        self.code: dict[str, int] = {}
        self.text: list[str | None] = []
        # Tokens of A, of B and groups of every unit; then its links, regular and other.
        self.sizes = np.zeros((0, 3), np.int64)
        self.links = [Runs(), Runs()]

    def learn(self, keys: Iterable[str]) -> None:
        """Make entries for the keys that have none; all are present afterwards."""
        distinct = set(keys)
        new = [key for key in distinct if key not in self.code]
        if len(self.code) + len(new) > self.limit:
            self._empty()
            new = list(distinct)
        plain, lone = [], []
        for key in new:
            (plain if _ends_well(_unit(key)) else lone).append(key)
        for at in range(0, len(plain), CALL_UNITS):
            own = plain[at : at + CALL_UNITS]
            if not self._add(own):
                lone += own
        for key in lone:
            if not self._add([key]):
                self.code[key] = len(self.text)
                self.text.append(None)
                self.sizes = np.concatenate([self.sizes, np.zeros((1, 3), np.int64)])
                for runs in self.links:
                    runs.add(np.zeros(0, np.int64), np.zeros(1, np.int64))

    def _add(self, keys: list[str]) -> bool:
        units = [" a", *map(_unit, keys)]  # a first unit that lets the others stand behind a character
        ends = np.cumsum([len(unit.encode()) for unit in units])
        found = self.pair.align("".join(units), ends)
        if found is None:
            return False
        stops = found.stops.tolist()
        begin = len(self.text)
        self.code.update(zip(keys, range(begin, begin + len(keys)), strict=True))
        self.text.extend(";".join(found.groups[a:b]) for a, b in zip(stops[:-1], stops[1:], strict=True))
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(np.stack([found.size_a, found.size_b, np.ones_like(found.size_a)], axis=1), axis=0)])
        self.sizes = np.concatenate([self.sizes, np.diff(sums[found.stops], axis=0)])
        packed = found.link_a * len(self.pair.bytes_b) + found.link_b
        of = np.searchsorted(found.stops, np.arange(len(found.groups)), side="right") - 1
        for runs, chosen, values in ((self.links[0], found.regular, found.link_a), (self.links[1], ~found.regular, packed)):
            chosen = chosen & (of >= 0)
            runs.add(values[chosen], np.bincount(of[chosen], minlength=len(keys)))
        return True


class Runs:
    """Runs of numbers, one per unit, that grow at the end."""

    def __init__(self):
        self.values, self.bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Append runs of these sizes."""
        self._new.append((values, sizes))

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the runs of ``codes`` in order, and the place in ``codes`` of each."""
        if self._new:
            self.values = np.concatenate([self.values, *(v for v, _ in self._new)])
            sizes = np.concatenate([s for _, s in self._new])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self._new = []
        size = self.bounds[codes + 1] - self.bounds[codes]
        owner = np.repeat(np.arange(len(codes)), size)
        first = np.repeat(self.bounds[codes] - (np.cumsum(size) - size), size)
        return self.values[first + np.arange(len(owner))], owner


def _counted(docs: np.ndarray, values: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """Distinct values of every row and how often they occur there."""
    found, n = np.unique(docs.astype(np.int64) << 32 | values, return_counts=True)
    bounds = pa.array(np.searchsorted(found >> 32, np.arange(rows + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(bounds, pa.array((found & 0xFFFFFFFF).astype(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(n.astype(np.int32)))


_LINKS = ArrayType(LongType(), False)
_TIMES = ArrayType(IntegerType(), False)
_STAGE = [
    StructField("n_a", LongType(), False),
    StructField("n_b", LongType(), False),
    StructField("n_groups", LongType(), False),
    StructField("groups", StringType(), False),
    StructField("_same", _LINKS, False),
    StructField("_same_n", _TIMES, False),
    StructField("_other", _LINKS, False),
    StructField("_other_n", _TIMES, False),
]


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every document's groups, and its links: ids of A that follow the identity map, other pairs."""
    schema = StructType([docs.schema.fields[0], *_STAGE])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept_table(("aligned", path_a, path_b), lambda: UnitTable(TokenPair(path_a, path_b)))
        pair = table.pair
        width = len(pair.bytes_b)
        for part in steps(batches, "text"):
            values = texts(part, "text")
            keys = [units_of(value) if value and pair.by_unit else [] for value in values]
            table.learn(key for row in keys for key in row)
            codes = np.array([table.code[key] for row in keys for key in row], np.int64)
            bounds = np.cumsum([0, *map(len, keys)])
            sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(table.sizes[codes], axis=0)])
            sizes = np.diff(sums[bounds], axis=0)
            listed = codes.tolist()
            groups, whole = [], {}
            for at, (value, a, b) in enumerate(zip(values, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = [table.text[code] for code in listed[a:b]]
                if value and (not own or None in own):
                    found = pair.align(" " + value, np.zeros(0, np.int64))
                    whole[at] = found
                    sizes[at] = (found.size_a.sum(), found.size_b.sum(), len(found.groups)) if found else 0
                    groups.append(";".join(found.groups) if found else "")
                else:
                    groups.append(";".join(own))
            lists = []
            for runs, regular in zip(table.links, (True, False), strict=True):
                links, owner = runs.take(codes)
                doc = np.searchsorted(bounds, owner, side="right") - 1
                if whole:
                    kept = ~np.isin(doc, np.fromiter(whole, np.int64, len(whole)))
                    added = [(at, x.link_a[x.regular] if regular else (x.link_a * width + x.link_b)[~x.regular]) for at, x in whole.items() if x]
                    links = np.concatenate([links[kept], *(v for _, v in added)])
                    doc = np.concatenate([doc[kept], *(np.full(len(v), at) for at, v in added)])
                lists += _counted(doc, links, len(values))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(sizes[:, k])) for k in range(3)), pa.array(groups, pa.string()), *lists], names=names)

    return docs.mapInArrow(run, schema)


def _id_counts(stage: DataFrame, size: int) -> np.ndarray:
    """How many regular links every id of A has; tasks add up a vector, which merges by id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, times = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            total += np.bincount(ids, weights=times, minlength=size).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["a", "n"])

    rows = stage.select("_same", "_same_n").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for row in rows:  # one per id of the vocabulary at most
        out[row["a"]] = row["n"]
    return out


def align_tokens(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    key: str = "doc_id",
    text: str = "text",
    keep: Callable[[Column], Column] = lambda groups: groups,
) -> DataFrame:
    """Every document's alignment: ``key, n_a, n_b, n_groups, groups, n_links, n_best, count_sum``.

    A is a byte-level BPE of the tokenizers library that encodes a space and the text, B a
    sentencepiece model that encodes the text; both paths must open on every executor. A group
    ends where tokens of both end, and its last tokens are linked. The count of an id pair is how
    many links of all documents hold it; ``n_best`` are the links whose count is the highest that
    their id of B has. ``groups`` lists the ids as in ``a1,a2|b1;a3|b2``; ``keep`` is applied to
    it before anything is stored (a digest, say).

    Null and empty texts, and texts whose joined token bytes are not a space and the text, have
    no tokens: zeros and no groups. Repeated rows are repeated and count again; other columns are
    not read, so none can clash; empty tables give none.
    """
    pair = TokenPair(path_a, path_b)
    width = len(pair.bytes_b)
    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text")) if key != "text" else docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    stage = written(_aligned(rows, path_a, path_b).withColumn("groups", keep(F.col("groups"))).withColumn("_row", F.monotonically_increasing_id()))

    counts = _id_counts(stage, len(pair.bytes_a))
    others = stage.select("_row", F.explode(F.arrays_zip("_other", "_other_n")).alias("x")).select("_row", F.col("x._other").alias("_pair"), F.col("x._other_n").alias("_times"))
    pairs = written(others.groupBy("_pair").agg(F.sum("_times").alias("_count")))
    best = np.zeros(width, np.int64)
    mapped = pair.identity >= 0
    np.maximum.at(best, pair.identity[mapped], counts[mapped])
    for row in pairs.groupBy((F.col("_pair") % width).alias("b")).agg(F.max("_count").alias("most")).collect():  # one per id of B at most
        best[row["b"]] = max(best[row["b"]], row["most"])
    is_best = counts >= best[np.maximum(pair.identity, 0)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, times = column(batch, "_same"), column(batch, "_same_n").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = same.flatten().to_numpy(zero_copy_only=False)
            size = np.array([len(x) for x in same.to_pylist()], np.int64) if same.offset else np.diff(same.offsets.to_numpy(zero_copy_only=False))
            bounds = np.concatenate([[0], np.cumsum(size)])
            out = []
            for values in (times * is_best[ids], times * counts[ids]):
                sums = np.concatenate([[0], np.cumsum(values)])
                out.append(pa.array(np.diff(sums[bounds]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([column(batch, "_row"), *out], names=["_row", "_best", "_sum"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = column(batch, "_pair").to_numpy(zero_copy_only=False)
            n = column(batch, "_count").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([column(batch, "_pair"), pa.array(n), pa.array((n >= best[own % width]).astype(np.int64))], names=["_pair", "_count", "_is_best"])

    regular = stage.select("_row", "_same", "_same_n").mapInArrow(add_up, "_row long, _best long, _sum long")
    marked = pairs.mapInArrow(mark, "_pair long, _count long, _is_best long")
    irregular = others.join(marked, "_pair").select("_row", (F.col("_times") * F.col("_is_best")).alias("_best"), (F.col("_times") * F.col("_count")).alias("_sum"))
    sums = regular.unionByName(irregular).groupBy("_row").agg(F.sum("_best").alias("n_best"), F.sum("_sum").alias("count_sum"))
    return stage.join(sums, "_row").select(key, "n_a", "n_b", "n_groups", "groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum")

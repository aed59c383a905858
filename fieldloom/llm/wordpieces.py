"""Token ids of whole texts by a word-level BPE tokenizer, through a table of distinct chunks."""

from __future__ import annotations

import json
import re
from struct import pack
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from fieldloom.llm.batches import ChunkTable, column, kept_table, steps, texts

# The normalizer steps and the word pattern of tokenizers whose words stand alone.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Chunks that may be cut between letters and other characters without changing a word:
# no apostrophe (endings), no "<|" (special tokens), nothing that composes or is white space.
_plain = re.compile(f"[{_LETTERS}!-&(-@\\[-`{{-~]+").fullmatch
_runs = re.compile(f"[{_LETTERS}]+|[^{_LETTERS}]+").findall
_letters = re.compile(f"[{_LETTERS}]+").fullmatch
# What commonly follows a word: signs that start no ending and no special token.
_TAIL = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


def byte_letters() -> list[str]:
    """The printable character that byte-level BPE uses for every byte: printable Latin-1 bytes
    stand for themselves, the others follow from 256 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordModel:
    """A tokenizer, and whether its words can be treated chunk by chunk."""

    def __init__(self, path: str):
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps_ = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_chunk = (
            steps_ == NORMALIZERS
            and cuts[0].get("pattern") == {"Regex": WORD_PATTERN}
            and cuts[0].get("behavior") == "Removed"
            and spec.get("post_processor") is None
            and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        )
        self.byte_letters = byte_letters()
        self.runs = kept_table(("runs", path), lambda: ChunkTable(self._run_ids))

    def whole(self, value: str) -> bytes:
        """Ids of a text as the library gives them, as little-endian 32-bit bytes."""
        return np.array(self.tokenizer.encode(value, add_special_tokens=False).ids, "<u4").tobytes()

    def _run_ids(self, runs: list[str]) -> list[bytes]:
        out = []
        tokenize = self.model.tokenize
        for run in runs:
            if _letters(run):
                mapped = run if run.isascii() else "".join(self.byte_letters[b] for b in run.encode())
                found = [token.id for token in tokenize(mapped)]
                out.append(pack(f"<{len(found)}I", *found))
            else:
                out.append(self.whole(run))
        return out

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without white space: letter runs are looked up, odd chunks go to the library."""
        cut: list[tuple[str, ...] | list[str] | None] = []
        for chunk in chunks:
            word = chunk.rstrip(_TAIL)
            if _letters(word):
                cut.append((word.lower(), chunk[len(word) :]) if len(word) < len(chunk) else (word.lower(),))
            else:
                cut.append(_runs(chunk.lower()) if _plain(chunk) and "<|" not in chunk else None)
        self.runs.learn(run for row in cut if row for run in row)
        get = self.runs.__getitem__
        return [
            self.whole(chunk) if row is None else get(row[0]) if len(row) == 1 else b"".join(map(get, row))
            for chunk, row in zip(chunks, cut, strict=True)
        ]

    def _pieces(self, chunks: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of letter runs, of what follows them and of other chunks, and which two of these
        every chunk is made of. Runs are compared in lower case and without what follows, so far
        fewer than chunks have to be looked up one by one."""
        word = pc.utf8_rtrim(chunks, characters=_TAIL)
        plain = pc.match_substring_regex(word, f"^[{_LETTERS}]+$")
        runs = pc.utf8_lower(word.filter(plain)).dictionary_encode()
        tails = pc.replace_substring_regex(chunks.filter(plain), f"^[{_LETTERS}]+", "").dictionary_encode()
        run, tail = runs.dictionary.to_pylist(), tails.dictionary.to_pylist()
        self.runs.learn([*run, *tail])
        odd = chunks.filter(pc.invert(plain)).to_pylist()
        table = kept_table(("words", self.path), lambda: ChunkTable(self.chunk_ids))
        known = [self.runs[x] for x in run] + [self.runs[x] for x in tail]
        table.learn(odd)  # may learn runs too, so it comes after they have been looked up
        pieces = [*known, *map(table.__getitem__, odd), b""]
        is_plain = plain.to_numpy(zero_copy_only=False)
        first = np.empty(len(chunks), np.int64)
        second = np.full(len(chunks), len(pieces) - 1, np.int64)
        first[is_plain] = runs.indices.to_numpy(zero_copy_only=False)
        second[is_plain] = len(run) + tails.indices.to_numpy(zero_copy_only=False)
        first[~is_plain] = len(known) + np.arange(len(odd))
        return pieces, first, second

    def ids(self, values: list[str]) -> Iterator[bytes]:
        """Ids of whole texts, put together from those of their distinct chunks by place."""
        if not self.by_chunk:
            yield from map(self.whole, values)
            return
        array = pa.array(values, pa.large_string())
        for space in ("\n", "\t", "\r"):
            array = pc.replace_substring(array, space, " ")
        split = pc.split_pattern(array, " ")
        words = split.flatten().dictionary_encode()
        pieces, first, second = self._pieces(words.dictionary)
        size = np.array([len(data) // 4 for data in pieces], np.int64)
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(pieces), "<u4")
        codes = words.indices.to_numpy(zero_copy_only=False)
        # Two pieces stand for every chunk.
        both = np.stack([first[codes], second[codes]], axis=1).ravel()
        ends = np.concatenate([[0], np.cumsum(size[both])])
        place = np.repeat(begin[both] - ends[:-1], size[both]) + np.arange(ends[-1])
        ids = flat[place]
        bounds = ends[2 * split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)].tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield ids[a:b].tobytes()


def token_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096, end_id: int | None = 1) -> DataFrame:
    """Pieces of at most ``limit`` tokens: ``key, piece, start, length, ids``.

    A document is the ids of its whole text and then ``end_id``; ``ids`` holds a piece's ids as
    little-endian 32-bit bytes. Only documents longer than ``limit`` are cut. Null and empty texts
    are the end id alone (no piece where ``end_id`` is None). Repeated rows are repeated; other
    columns are left out, so none can clash.
    """
    schema = StructType(
        [
            docs.schema[key],
            StructField("piece", IntegerType(), False),
            StructField("start", LongType(), False),
            StructField("length", LongType(), False),
            StructField("ids", BinaryType(), False),
        ]
    )
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = WordModel(model)
        for part in steps(batches, text):
            rows, piece, start, length, ids = [], [], [], [], []
            for at, data in enumerate(use.ids(texts(part, text))):
                data += tail
                for number, begin in enumerate(range(0, len(data), 4 * limit)):
                    own = data[begin : begin + 4 * limit]
                    rows.append(at)
                    piece.append(number)
                    start.append(begin // 4)
                    length.append(len(own) // 4)
                    ids.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    column(part, key).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=names,
            )

    return docs.select(key, text).mapInArrow(run, schema)

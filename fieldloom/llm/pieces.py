"""SentencePiece ids and texts through a table of distinct marked words.

The model puts a marker before every word (and one before the text), and no piece holds a marker
after another character, so a marked word is segmented alike wherever it stands. Each distinct
marked word is segmented once and its ids are put back by position. The table belongs to a Python
worker: a table for the whole corpus would shuffle a row per word of the corpus to save work that
repeated words cost only once per worker anyway.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from fieldloom.llm.batches import ChunkTable, add_columns, kept_table, texts

MARK = "▁"
_marked_words = re.compile(" +[^ ]*").findall


class PieceModel:
    """A model with what encoding and decoding by table need."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        count = self.processor.get_piece_size()
        names = [self.processor.id_to_piece(i) for i in range(count)]
        spaced = [name.replace(MARK, " ") for name in names]
        # A piece of markers alone only joins markers; any other may begin with them, not go on to one.
        self.by_word = all(" " not in s.lstrip(" ") for s in spaced) and self._keeps_spaces()
        self.surface = [self._surface(i, spaced[i]) for i in range(count)]

    def _keeps_spaces(self) -> bool:
        return self.processor.decode(self.processor.encode(" a  b ﬁ ")) == " a  b ﬁ "

    def _surface(self, i: int, spaced: str) -> bytes:
        if self.processor.is_control(i):
            return b""
        if self.processor.is_byte(i):
            return bytes([int(spaced[3:-1], 16)])
        if self.processor.is_unknown(i):
            return " ⁇ ".encode()
        return spaced.encode()

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of marked words (given without their first marker), as little-endian 32-bit bytes."""
        alone = [self.processor.piece_to_id(MARK)]  # the library marks no empty text
        found = self.processor.encode(words, num_threads=1)
        return [np.array(ids if word else alone, "<i4").tobytes() for word, ids in zip(words, found, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The marker before the text is no part of it."""
        data = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if not self.processor.is_control(i)), None)
        try:
            text = data.decode()
        except UnicodeDecodeError:  # bytes that make no character: left to the library
            return self.processor.decode(ids)
        if first is not None and not self.processor.is_unknown(first) and text.startswith(" "):
            return text[1:]
        return text


def _words(text: str) -> list[str]:
    """Marked words of a text, each without its first marker."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [word[1:] for word in _marked_words(" " + text)]
    return text.split(" ")


def encode(
    docs: DataFrame,
    model: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = None,
) -> DataFrame:
    """Add the ids of every whole text, and with ``decoded`` the text the ids decode to.

    ``model`` is a path every executor can open. Null and empty texts have no ids and decode to
    the empty text; repeated rows give repeated rows; other columns stay, except that columns
    named like an added one are replaced. A model with pieces that cross markers, or whose
    normalizer changes texts, is applied to whole texts instead.
    """
    added = [StructField(ids, ArrayType(IntegerType(), False), False)]
    if decoded:
        added.append(StructField(decoded, StringType(), False))

    def work():
        use = PieceModel(model)
        table = kept_table(("pieces", model), lambda: ChunkTable(use.segment))

        def act(part: pa.RecordBatch) -> list[pa.Array]:
            values = texts(part, text)
            if use.by_word:
                words = [_words(value) for value in values]
                table.learn(word for row in words for word in row)
                rows = [b"".join(map(table.__getitem__, row)) for row in words]
            else:
                rows = [row if value else b"" for row, value in zip(use.segment(values), values, strict=True)]
            ends = np.cumsum([0, *(len(row) // 4 for row in rows)]).astype("int32")
            flat = np.frombuffer(b"".join(rows), "<i4")
            out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if decoded:
                out.append(pa.array([use.decode(np.frombuffer(row, "<i4").tolist()) for row in rows], pa.string()))
            return out

        return act

    return add_columns(docs, text, added, work)

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldloom.llm import packing, pieces, wordpieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a'sb 'S it's I'LL", "<|endoftext|> x<|endoftext|>y", "é é café", "ÀÉ ß ÿ İ K", "a\tb\r\nc\x0bd\x0ce",
    "a b c", "½ ² Ⅷ ٣", "汉字 かな 🎉👍🏽", "a_b-c.d@e.f", "x'", "!'s x’s", "\x00\x01 a\x7fb", "  a  b ", "▁a ▁▁b", "a ▁", "<0x41> <s> </s> <unk>", "end ",
]


def texts():
    rng = random.Random(1)
    alphabet = "aé'sS<|>endoftx \ńıßΣ½▁ "
    return ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)] + ["word, " * 30000]


def test_pieces_equal_the_library(make_docs):
    given = texts()
    docs = make_docs([*enumerate(given), (len(given), None)], extra="decoded")
    got = {r.doc_id: r for r in pieces.encode(docs, PIECES, decoded="decoded").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, text in enumerate([*given, ""]):
        ids = library.encode(text)
        assert got[i].ids == ids and got[i].decoded == library.decode(ids), text


def test_decode_of_odd_ids():
    model, library = pieces.PieceModel(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for ids in ([], [0], [1, 264, 2], [0, 264], [3 + 0xC3], [3 + 0xC3, 3 + 0xA9], [28705, 28705, 264]):
        assert model.decode(ids) == library.decode(ids), ids


def test_token_pieces_equal_the_library(make_docs):
    given = texts()
    docs = make_docs([*enumerate(given), (len(given), None)], extra="piece")
    rows = wordpieces.token_pieces(docs, WORDS, limit=1000).collect()
    library = Tokenizer.from_file(WORDS)
    for i, text in enumerate([*given, ""]):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids, text
        assert [r.start for r in own] == list(range(0, len(ids), 1000)) and all(r.length == 1000 for r in own[:-1])


def test_bounds_and_best_fit():
    rng = np.random.default_rng(2)
    for top in (10, 40, 100):
        lengths = rng.integers(1, top + 1, 500)
        bins, places = packing.best_fit_decreasing(lengths, 100)
        filled = np.bincount(bins, weights=lengths)
        bound = packing.bin_bound(np.bincount(lengths, minlength=101), 100)
        assert filled.max() <= 100 and bound <= len(filled) <= bound * 1.05 + 1
        assert (places + lengths <= 100).all()
    # Three of 34 never share a bin of 100 with a fourth; two of 51 never share one.
    assert packing.bin_bound(np.bincount([34] * 6, minlength=101), 100) == 3
    assert packing.bin_bound(np.bincount([51] * 7 + [10] * 3, minlength=101), 100) == 7


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i % 700, 0, rng.randint(1, 90)) for i in range(3000)] + [(None, 0, 100), (1, 1, 100)]
    items = spark.createDataFrame(rows, "doc_id long, offset int, length long")
    got = packing.pack(items, 100, group_rows=200).collect()
    assert len(got) == len(rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 100
    bound = packing.bin_bound(np.bincount([n for *_, n in rows], minlength=101), 100)
    alone = len(np.unique(packing.best_fit_decreasing(np.array([n for *_, n in rows]), 100)[0]))
    assert bound <= len(bins) <= alone * 1.01 + 1
    assert packing.pack(items.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items, 50)

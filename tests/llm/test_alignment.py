from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldloom.llm import alignment
from fieldloom.llm.wordpieces import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    "", None, " ", "a", " a", "a ", "  a  b ", "a\nb", "a\n\nb", "\n", "\na", "a\n", "a \n b", "a\n b", "a \nb\t c",
    "x▁y", "a b c", "café 你好 \U0001f600 ok", "don't 's 're it's", "<s> </s> <|endoftext|> hi", "a\r\nb",
    "1234 5678.90", " a   b", "tab\tsep \x1c x", "é ﬁ x", "a  b\n  c\n\n\n d", "\x00 a", "word " * 50, "I 'll",
    "a 's b", "the the the", "the the the", " a 　 b", "x" * 3000,
]


def brute(rows):
    """Every text encoded whole by the libraries."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    token = {i: bytes(byte_of.get(c, 0) for c in t) for t, i in a.get_vocab().items()}

    def piece(i):
        own = b.id_to_piece(i)
        return bytes([int(own[3:5], 16)]) if b.is_byte(i) else own.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for key, text in rows:
        groups, links = [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        x, y = [token[i] for i in ids_a], [piece(i) for i in ids_b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            ids_a, ids_b, x, y = [], [], [], []
        place = {end: i for i, end in enumerate(accumulate(map(len, x)))}
        begin_a = begin_b = 0
        for j, end in enumerate(accumulate(map(len, y))):
            if end in place:
                i = place[end]
                links.append((ids_a[i], ids_b[j]))
                groups.append(",".join(map(str, ids_a[begin_a : i + 1])) + "|" + ",".join(map(str, ids_b[begin_b : j + 1])))
                begin_a, begin_b = i + 1, j + 1
        counts.update(links)
        docs.append((key, len(ids_a), len(ids_b), ";".join(groups), links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return sorted((k, m, n, len(ls), g, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls)) for k, m, n, g, ls in docs)


def found(df):
    return sorted(tuple(r) for r in alignment.align_tokens(df, A, B).collect())


@pytest.fixture
def odd(spark):
    rows = list(enumerate(ODD))
    return rows, spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_a string, _row int").repartition(3)


def test_equals_the_libraries_on_whole_texts(spark, odd):
    rows, df = odd
    assert found(df) == brute(rows)


def test_small_unit_table_and_calls(spark, odd, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(alignment, "UNIT_LIMIT", 7)
    monkeypatch.setattr(alignment, "CALL_UNITS", 3)
    assert found(df) == brute(rows)


def test_without_units(spark, odd, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(alignment.TokenPair, "_cuts_b", lambda self: False)
    assert found(df) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "ab cd")] * 3 + [(None, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.align_tokens(df, A, B).collect()
    expected = {r[0]: r for r in brute([(1, "ab cd")] * 3 + [(0, "ab")])}
    assert sorted(r["count_sum"] for r in got) == sorted([expected[1][7]] * 3 + [expected[0][7]])
    assert sum(r["doc_id"] is None for r in got) == 1
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_units_join_to_the_text():
    for text in ODD:
        if text:
            keys = alignment.units_of(text)
            assert "".join(map(alignment._unit, keys)) == " " + text


def test_identity_map_has_the_same_bytes():
    pair = alignment.TokenPair(A, B)
    mapped = [(i, j) for i, j in enumerate(pair.identity.tolist()) if j >= 0]
    assert pair.by_unit and len(mapped) > 10_000
    assert all(pair.bytes_a[i] == pair.bytes_b[j] for i, j in mapped)

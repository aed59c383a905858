import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldloom.llm import quotient
from fieldloom.llm.collocations import collocations, scan_pieces


def brute(rows, least=10, top=2000):
    """rows: (text, lang) -> lang, rank, phrase, a, l, r, n, score."""
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        some = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        inside = Counter()
        for g, c in some.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    inside[part] = max(inside[part], c)
        kept = []
        for g, a in some.items():
            if len(g) == 2 and 100 * inside[g] >= 50 * a:
                continue
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in collocations(df, **options).collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["The", "é", "ß" * 200, "a-b", "x", "Y", "z9", "  ", "\t", "q"]
    marks = [" ", " ", " ", " ", ". ", ",", "\n", "\x0b", "!", " ; "]
    rows = [("".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.choice([0, 1, 2, 40, 300]))), rng.choice(["en", "de", None, "und"])) for _ in range(60)]
    return rows + [(None, "en"), ("", "en"), ("   ", "fr"), (None, None)] + [("new york city", "en")] * 12 + [("new york", "en")] * 7


def test_equals_plain_loops(spark, texts):
    df = spark.createDataFrame([(t, x, 1, 2) for t, x in texts], "text string, lang string, w1 int, rank int").repartition(3)
    assert found(df) == brute(texts)
    assert found(df, top=3) == brute(texts, top=3)
    assert found(df, least=25) == brute(texts, least=25)


def test_filters_split_over_tasks_and_parts(spark, texts, monkeypatch):
    monkeypatch.setattr(quotient, "FILTER_GRAMS", 50)
    df = spark.createDataFrame(texts, "text string, lang string").repartition(4)
    assert found(df) == brute(texts)


def test_empty_table_and_few_words(spark):
    assert found(spark.createDataFrame([], "text string, lang string")) == []
    assert found(spark.createDataFrame([("a b", "en")] * 9, "text string, lang string")) == []
    assert found(spark.createDataFrame([("a b", "en")] * 10, "text string, lang string")) == [("en", 1, "a b", 10, 10, 10, 20, 1000000)]


def test_very_long_text(spark):
    text = "a b c " * 50_000 + "d" * 100_000
    assert found(spark.createDataFrame([(text, "en")], "text string, lang string")) == brute([(text, "en")])


def test_words_whose_power_sums_collide_stay_apart(spark):
    def thue(n, a, b):
        return "".join(a if bin(i).count("1") % 2 else b for i in range(1 << n))

    rows = [(f"{thue(11, 'a', 'b')} x", "en")] * 10 + [(f"{thue(11, 'b', 'a')} x", "en")] * 12
    assert found(spark.createDataFrame(rows, "text string, lang string")) == brute(rows)


@pytest.mark.parametrize("rest", [1, 2])
@pytest.mark.parametrize("bits", [0, 8])
def test_filter_loses_nothing(rest, bits):
    rng = np.random.default_rng(rest)
    ids = [rng.integers(0, 50, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(rest + 1)]
    spread = quotient.permute(ids)
    assert all((a == b).all() for a, b in zip(ids, quotient.restore(spread, ids[1:]), strict=True))
    own, others, counts = quotient.combine(spread, ids[1:], None)
    expected = Counter(zip(*(x.tolist() for x in ids), strict=True))
    counts = counts * rng.integers(1, 10**12, len(counts))
    got = Counter()
    shards = own >> np.uint64(64 - bits) if bits else np.zeros(len(own), np.uint64)
    for shard in np.unique(shards).tolist():
        of = shards == shard
        data = quotient.encode(own[of], [x[of] for x in others], counts[of], bits)
        s, r, c = quotient.decode(data, int(shard), bits, rest)
        assert (c == counts[of]).all()
        got.update(zip(*(x.tolist() for x in quotient.restore(s, r)), strict=True))
    assert got.keys() == expected.keys() and sum(expected.values()) == 4000


def test_equal_spread_bits_are_told_apart():
    spread = np.array([7, 7, 3, 7], np.uint64)
    rest = [np.array([1, 2, 5, 1], np.uint64)]
    own, others, counts = quotient.combine(spread, rest, None)
    assert list(zip(own.tolist(), others[0].tolist(), counts.tolist(), strict=True)) == [(3, 5, 1), (7, 1, 2), (7, 2, 1)]


def test_pieces():
    import pyarrow as pa

    words, pieces = scan_pieces(pa.array(["A b. c", None, "d\ne"]))
    assert [words.data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)] == [b"a", b"b", b"c", b"d", b"e"]
    assert [pieces[i + 1] == pieces[i] for i in range(4)] == [True, False, False, False]

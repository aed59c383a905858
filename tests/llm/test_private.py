import random
import re

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import private

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    own = [int(c) for c in digits[::-1]]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(own)) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS.values()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(part) > 255 for part in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


ODD = [
    None, "", "a@b.c_d@e.f", "x@y.z é a.b@c.d.", "999.1.2.3.4 1.2.3.4.5.6.7.8", "0000001.2.3.4 1.2.3", "256.1.1.1 1.2.3.4",
    "+1 (017) 555-7713, +12 3 +123456789012345678", "4111 1111 1111 1111 4111-1111-1111-1111 4111 1111 1111 1112",
    "1 2 3 4 5 6 7 8 9 0 1 2 3", "\U0001f600 4111111111111111 \U0001f600 a@b.co", "a@b a@b. @b.c", "+1+2+3+44 20 7946 0958",
    "9" * 20_000, "a" * 20_000 + "@", "1 " * 10_000, "+" * 1000 + "1 " * 3000, "a@b.c " * 500, "a@b.c" * 50,
]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "B9", "@", ".", "-", "+", " ", "1", "25", "4111111111111111", "1.2.3.4", "x@y.z", "é", "(", ")", "_", "%", "+1 555 123 4567"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(n)]


def spans(row, name):
    return [(s["start"], s["kind"], s["end"]) for s in row[name]]


def test_base_spans_equal_plain_loops(spark):
    rows = ODD + random_texts(400)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], "doc_id long, text string, spans string, kind string")
    got = private.find_private(df, private.Selector()).collect()
    assert len(got) == len(rows)
    for row in got:
        assert spans(row, "base_spans") == spans(row, "spans") == brute(row["text"])
        assert row["kind"] == "y"


@pytest.fixture(scope="module")
def trained(spark):
    """People write to each other; order numbers look like cards that fail their check."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))

    def card():
        own = "".join(rng.choices("0123456789", k=15))
        return next(own + c for c in "0123456789" if luhn(own + c))

    rows = []
    for i in range(600):
        text = [word() for _ in range(8)]
        text.insert(4, rng.choice([f"{word()}@{word()}.com", f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", ".".join(str(rng.randint(0, 255)) for _ in range(4)), card(), "order " + "".join(rng.choices("0123456789", k=16)), "no 12/05/2023", "in 2024-01-15 x"]))
        rows.append((i, " ".join(text)))
    sample = private.labelled_proposals(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    return private.fit_selector(sample)


def test_trees_add_what_looks_like_base_spans(spark, trained):
    texts = {
        "write to abcabc (at) defdef (dot) com today": [(9, 0, 37)],
        "write to abcabc at defdef dot com today": [(9, 0, 33)],
        "call abcdef (317) 555-7713 abcdef": [(12, 3, 26)],
        "on 12/05/2023 we met": [],
        "version 999.1.2.3 of abc": [],
        "order 4111111111111112 abc": [],
        "nothing here": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["text"]: spans(r, "spans") for r in private.find_private(df, trained).collect()}
    assert got == texts


def test_base_spans_stay_and_added_ones_do_not_overlap(spark, trained):
    rows = random_texts(300, seed=9)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for row in private.find_private(df, trained).collect():
        base, all_ = spans(row, "base_spans"), spans(row, "spans")
        assert base == brute(row["text"])
        assert set(base) <= set(all_) and all_ == sorted(all_)
        added = [s for s in all_ if s not in base]
        for s in added:
            assert all(s[2] <= o[0] or o[2] <= s[0] for o in all_ if o != s)


def test_without_examples_nothing_is_added(spark):
    df = spark.createDataFrame([(1, "call (317) 555-7713"), (2, None), (2, None)], "doc_id long, text string")
    got = private.find_private(df).collect()
    assert len(got) == 3 and all(r["spans"] == [] for r in got)
    assert private.find_private(df.limit(0)).count() == 0


def test_all_rows_and_spans_are_learned_from(spark):
    many = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("to me@b.co now").alias("text"))
    got = private.labelled_proposals(many, "doc_id", "text").groupBy("label").agg(F.sum("n").alias("n")).collect()
    assert {r["label"]: r["n"] for r in got} == {1.0: 50_000, 0.0: 150_000}
    long = spark.createDataFrame([(1, "a@b.co " * 300 + "1.2.3.4 " * 200)], "doc_id long, text string")
    rows = private.labelled_proposals(long, "doc_id", "text").where("label = 1").groupBy("kind").agg(F.sum("n").alias("n")).collect()
    assert {r["kind"]: r["n"] for r in rows} == {0.0: 300, 1.0: 200}


def test_labels_equal_a_plain_loop(spark):
    texts = [t or "" for t in ODD if len(t or "") < 1000] + random_texts(200, seed=4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {kind: 0 for kind in range(4)}
    for row in private.proposals(df, "text").collect():
        for s in row["_spans"]:
            for b in row["_spans"]:
                shared = min(b["end"], s["end"]) - max(b["start"], s["start"])
                want[b["kind"]] += b["base"] and 2 * shared >= max(b["end"], s["end"]) - min(b["start"], s["start"])
    got = private.labelled_proposals(df, "doc_id", "text").where("label = 1").groupBy("kind").agg(F.sum("n").alias("n")).collect()
    assert {int(r["kind"]): r["n"] for r in got} == {k: n for k, n in want.items() if n}


def test_texts(spark):
    df = spark.createDataFrame([("a@b.co x 1.2.3.4",), ("+1 4111 1111 1111 11 a@b.c",), ("none",)], "text string")
    rows = private.find_private(df, private.Selector(), key="text")
    got = [tuple(r) for r in rows.select(private.as_text(F.col("spans")), private.redacted(F.col("text"), F.col("spans")), private.count_of(F.col("spans"), "ip")).collect()]
    assert got[0] == ("email:0:6,ip:9:16", "[email] x [ip]", 1)
    assert got[2] == ("", "none", 0)

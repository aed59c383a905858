import random

import pytest


@pytest.fixture
def make_docs(spark):
    """A documents table with an extra column that clashes with operators' names."""

    def make(rows, extra="lang"):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], f"doc_id long, text string, {extra} string")

    return make


@pytest.fixture
def family():
    """Texts with near copies, shared passages, short texts, empties and ties."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([3, 6, 9, 30, 120, 300]))
        rows.append(" ".join(words))
        for edits in range(rng.randint(0, 6)):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy).title() if edits == 2 else "\n ".join(copy))
        rows.append(" ".join(rng.choices(vocabulary, k=15)) + " " + passage + " " + " ".join(rng.choices(vocabulary, k=60)))
    rows += ["", None, "one", "one", "the " * 60, "the " * 90, "a b c d", "A B C D", "é ü ß", " \t\n"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i * 3 + 1, rows[at]) for i, at in enumerate(order)]

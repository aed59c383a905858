from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import exact, shards

ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "a "), (7, "long " * 5000), (8, "long " * 5000), (8, "long " * 5000), (None, "b"), (None, "only")]


def test_marks(make_docs):
    docs = make_docs(ROWS, extra="kept")
    for digest in (exact.text_digest, lambda t: F.length(t).cast("string"), lambda t: F.lit("one")):
        got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact.mark_duplicates(docs, digest=digest).collect())
        assert got == [
            (0, 0, 1, True),
            (0, 3, 2, False),
            (1, 2, 2, False),
            (2, 2, 2, True),
            (3, 3, 2, True),
            (4, 5, 2, False),
            (5, 5, 2, True),
            (6, 6, 1, True),
            (7, 8, 3, False),
            (8, 8, 3, True),
            (8, 8, 3, True),
        ]


def test_deduplicated_and_empty(make_docs):
    kept = exact.deduplicated(make_docs(ROWS))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == [(0, 4), (2, 1), (3, 1), (5, 0), (6, 2), (8, 25000)]
    assert exact.mark_duplicates(make_docs(ROWS).limit(0)).count() == 0


def test_jump_moves_only_to_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20000).astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in (1, 2, 7, 16):
            a, b = shards.jump(keys, n), shards.jump(keys, n + 1)
            assert a.max() == n - 1 and ((a == b) | (b == n)).all()
            assert abs((b == n).mean() - 1 / (n + 1)) < 0.02


def test_slots(spark):
    rows = [(i, "x") for i in range(2000)] + [(5, "x"), (5, "x"), (None, "y"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, shard string")
    got = shards.shard(docs, 16, rows_per_block=50).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == 16
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert shards.shard(docs.limit(0)).count() == 0


def test_jump_equals_the_plain_walk():
    def plain(key, shards):
        at, ahead = -1, 0
        while ahead < shards:
            at = ahead
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            ahead = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return at

    keys = [0, 1, 2, 10, (1 << 64) - 1, *np.random.default_rng(2).integers(0, 1 << 63, 300).tolist()]
    for n in (1, 2, 3, 16, 17, 1000):
        with np.errstate(over="ignore"):
            assert shards.jump(np.array(keys, np.uint64), n).tolist() == [plain(k, n) for k in keys]


def test_slots_with_columns_that_clash(spark):
    names = "_block _rows _start _at _key _rest".split()
    docs = spark.createDataFrame([(i, *names) for i in range(200)], ", ".join(["doc_id long", *[f"`{c}` string" for c in names]]))
    got = shards.shard(docs, 4, rows_per_block=20)
    assert got.columns == [*docs.columns, "shard", "grown_shard", "slot"]
    assert all([r[c] for c in names] == names for r in got.collect())

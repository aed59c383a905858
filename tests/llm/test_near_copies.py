import random

import pytest
from pyspark.sql import functions as F

from brute import components, shingles, without_repeats
from fieldloom.llm import components as links
from fieldloom.llm import fingerprints, jaccard, substrings


def test_jaccard_equals_all_pairs(make_docs, family):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(make_docs(family, extra="size")).collect()}
    assert got == components(family)


def test_jaccard_many_copies_of_one_text(make_docs):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(250):
        copy = list(base)
        for _ in range(i % 7):
            copy[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(make_docs(rows)).collect()}
    assert got == components(rows)


def test_jaccard_null_keys_and_empty(make_docs):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (4, text), (4, text), (None, None), (9, "")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.near_duplicates(make_docs(rows)).collect())
    assert got == [(-1, 0, -1), (-1, 16, 4), (4, 16, 4), (4, 16, 4), (9, 0, 9)]
    assert jaccard.near_duplicates(make_docs(rows).limit(0)).count() == 0


@pytest.mark.parametrize("boundary", [0, 12, 256])
def test_any_boundary_finds_the_same_candidates(make_docs, family, boundary, monkeypatch):
    monkeypatch.setattr(jaccard, "small_boundary", lambda firsts: boundary)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(make_docs(family)).collect()}
    assert got == components(family)


def test_jaccard_joins_linkable_sets_of_any_input_only(make_docs, monkeypatch):
    """More shingles than a sketch has cells, and exact copies, bring no other sets to the join."""
    from fieldloom.llm import sketch

    monkeypatch.setattr(sketch.sketch_bits, "__defaults__", (16,))
    joined = []
    monkeypatch.setattr(jaccard, "set_links", lambda sets, f=jaccard.set_links: (joined.append(sets.count()), f(sets))[1])
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(1000)] for _ in range(250)]
    rows = [(i, " ".join(words)) for i, words in enumerate([*texts, *texts[:40], [*texts[7][:950], "an", "edit"]])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(make_docs(rows)).collect()}
    assert got == {i: (948 if i == 290 else 996, 7 if i == 290 else i % 250) for i in range(291)}
    assert joined == [2]


def test_repeating_keys_equal_a_count(spark, monkeypatch):
    """Values that repeat within a part, across parts and in most rows are all counted, once a row."""
    import numpy as np

    from fieldloom.llm import repeats
    from fieldloom.llm.words import mix

    monkeypatch.setattr(repeats, "PART_VALUES", 60)
    monkeypatch.setattr(repeats, "ANSWER_BYTES", 20)
    rng = random.Random(6)
    sets = [(i, rng.randint(0, 12), sorted({0, *rng.choices(range(1, 900), k=rng.randint(0, 25))})) for i in range(300)] + [(300, 0, []), (301, 1, [])]
    df = spark.createDataFrame(sets, "key long, need int, own array<long>").repartition(7)

    def rows(batches):
        for batch in batches:
            for key, need, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield key, need, mix(np.array(own, np.uint64))

    counts = {}
    for _, _, own in sets:
        for value in own:
            counts[value] = counts.get(value, 0) + 1
    got = sorted(r.key for r in repeats.repeating_keys(df, rows, 4000).collect())
    assert got == [key for key, need, own in sets if sum(counts[value] > 1 for value in own) >= need]
    assert 0 < len(got) < 290


def test_released_shuffles_and_discarded_stages(spark):
    """A released table leaves no shuffle files behind, a discarded one no folder."""
    import time
    from pathlib import Path

    from fieldloom.llm import stage

    def files():
        folders = [Path(str(p)) for p in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
        return {p for folder in folders for p in folder.rglob("shuffle_*")}

    before, setting = files(), spark.conf.get(stage.CLEAN_SHUFFLES)
    table = stage.written(spark.range(1000).repartition(5, "id"), release=True)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(stage.CLEAN_SHUFFLES) == setting
    assert table.count() == 1000 and Path(table.stage_folder.removeprefix("file:")).exists()
    stage.discard(table)
    assert not Path(table.stage_folder.removeprefix("file:")).exists()


def test_components_of_a_chain(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(links.components(spark.createDataFrame(rows, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("step", [300, 400_000])
def test_substrings_equal_a_loop(make_docs, family, step, monkeypatch):
    monkeypatch.setattr(substrings, "STEP_WINDOWS", step)
    rows = family + [(1000 + i, t) for i, (_, t) in enumerate(family[:20])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(make_docs(rows, extra="n_words")).collect()}
    assert got == without_repeats(rows)


def test_substrings_odd_keys(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (2, "short"), (None, None)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substrings.remove_repeats(make_docs(rows)).collect())
    assert got == [(-1, 0, 0), (-1, 30, 30), (2, 1, 0), (5, 30, 0), (5, 30, 0)]
    assert substrings.remove_repeats(make_docs(rows).limit(0)).count() == 0


def test_sketch_never_loses_a_repeated_value(spark):
    import numpy as np

    from fieldloom.llm.sketch import may_repeat, merged_sketch

    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    twice = values[:200]
    rows = [(int(v),) for v in np.concatenate([values, twice]).view(np.int64)]
    df = spark.createDataFrame(rows, "v long").repartition(5)
    sketch = merged_sketch(df, lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), 18, 2)
    found = may_repeat(values, sketch.value, 18, 2)
    assert found[:200].all() and found[200:].mean() < 0.1


def likeness(a, b):
    a, b = shingles(a, lower=False), shingles(b, lower=False)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(make_docs, family):
    rows = {r.doc_id: r for r in fingerprints.edited_pairs(make_docs(family)).collect()}
    order = sorted(family, key=lambda r: -r[0])
    for at, (i, text) in enumerate(order):
        text, following = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert rows[i].edited == edited
        assert abs(rows[i].near_edited - likeness(text, edited)) < 0.2
        assert abs(rows[i].near_next - likeness(text, following)) < 0.2
        if len(shingles(text, lower=False)) + len(shingles(edited, lower=False)) <= fingerprints.K:
            assert rows[i].near_edited == pytest.approx(likeness(text, edited))


def test_next_rows_across_groups(make_docs):
    ids = [0, 1, 1023, 1024, 5000, 10**7, 10**10]
    rows = {r.doc_id: r.next_text for r in fingerprints.with_next(make_docs([(i, f"t{i}") for i in ids])).collect()}
    assert rows == {i: f"t{ids[at - 1]}" for at, i in enumerate(ids)}
    assert [r.next_text for r in fingerprints.with_next(make_docs([(3, "alone")])).collect()] == ["alone"]
    assert len(fingerprints.with_next(make_docs([(3, "a"), (3, "a"), (None, None), (None, "b")])).collect()) == 4
    assert fingerprints.with_next(make_docs([(3, "a")]).limit(0)).count() == 0


def test_sketches_merge_and_estimate(spark):
    text = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(text[:1600])), (1, " ".join(text[1596:])), (2, " ".join(text)), (3, " ".join(text[:1500]))]
    docs = spark.createDataFrame(rows, "part long, text string")
    some = fingerprints.fingerprints(docs)
    whole = {r.part: r.sketch for r in fingerprints.merge_sketches(some, ["part"], "sketch").collect()}
    assert whole[1] == whole[2]
    pair = spark.createDataFrame([(whole[2], whole[3])], "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    n, inside, back, r = pair.select(
        fingerprints.distinct_shingles(a), fingerprints.containment(b, a), fingerprints.containment(a, b), fingerprints.resemblance(a, b)
    ).first()
    assert abs(n - 2996) < 900 and inside > 0.8 and abs(back - 0.5) < 0.2 and abs(r - 0.5) < 0.15


def test_removal_with_columns_that_clash(spark):
    names = "key body _found _key _body _at _mask _given _rest _text".split()
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, text, *names) for i in range(3)], ", ".join(["doc_id long, text string", *[f"`{c}` string" for c in names]]))
    got = substrings.remove_repeats(docs)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == [(0, 0), (1, 30), (2, 30)]
    assert all([r[c] for c in names] == names for r in got.collect())


def test_next_rows_of_sparse_keys(spark, monkeypatch):
    """Hashed 64-bit keys fall into even groups; null keys and repeated ones are parted by text."""
    monkeypatch.setattr(fingerprints, "MOST_GROUPS", 40)
    monkeypatch.setattr(fingerprints.group_firsts, "__defaults__", (16, 40))
    docs = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, F.xxhash64("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")
    )
    rows = docs.withColumn("_place", fingerprints.place_of(F.col("doc_id"), F.col("text")))
    firsts = fingerprints.group_firsts(rows.select("_place"), 4000)
    sizes = rows.groupBy(fingerprints.group_at(F.col("_place"), firsts).alias("g")).count().collect()
    assert len(sizes) >= 40 and max(r["count"] for r in sizes) <= 100 and min(r.g for r in sizes) == 0
    found = {r.text: r.next_text for r in fingerprints.with_next(docs).collect()}
    order = [r.text for r in rows.orderBy(F.desc("_place")).collect()]
    assert found == dict(zip(order, order[1:] + order[:1], strict=True))
    keys = [r.doc_id for r in rows.orderBy(F.desc("_place")).collect() if r.doc_id is not None]
    assert keys == sorted(keys, reverse=True)

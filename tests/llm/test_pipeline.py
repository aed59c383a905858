import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from brute import components, without_repeats
from fieldloom.llm.queries import QUERIES


def corpus():
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=55)
    docs = []
    for base in range(60):
        words = rng.choices(vocabulary, k=rng.choice([4, 30, 150, 900]))
        if base % 5 == 0:
            words[2:2] = passage
        if base % 7 == 0:
            words += ["idiot", "scum"]
        docs.append(" ".join(words))
        if base % 3 == 0:
            docs += [docs[-1]] * 2
        if base % 4 == 0 and len(words) > 100:
            docs.append(" ".join([*words[:50], "changed", *words[51:]]))
    docs += [None, "", "", "x " * 9000]
    return list(enumerate(docs))


def test_run_equals_plain_loops(spark, tmp_path):
    rows = corpus()
    labels = [(i, 0, int("idiot" in (t or ""))) for i, t in rows if i % 2]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    clean = [(i, t) for i, t in rows if "idiot" not in (t or "")]
    last = {}
    for i, t in clean:
        last[t or ""] = i
    clean = [(i, t) for i, t in clean if last[t or ""] == i]
    group = components(clean)
    clean = [(i, t) for i, t in clean if group[i][1] == i]
    cut = without_repeats(clean)
    texts = {i: cut[i][2] if cut[i][1] else t or "" for i, t in clean}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    assert {r.doc_id: r.text or "" for r in kept.collect()} == texts
    assert all(r.n_chars == len(r.text or "") for r in kept.collect())

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == lengths
    filled = {}
    for r in got:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 4096 and len(filled) == int(np.ceil(sum(lengths.values()) / 4096))


INNER = "score held_out predicted n_words n_removed kept_text _key _rest _text keep_id key body".split()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_that_clash(spark, tmp_path, name):
    labels = spark.createDataFrame([(i, 0, int("idiot" in (t or ""))) for i, t in corpus()], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    schema = ", ".join(["doc_id long, text string, n_chars long", *[f"`{c}` string" for c in INNER]])
    docs = spark.createDataFrame([(i, t, len(t or ""), *[f"own {c} {i}" for c in INNER]) for i, t in corpus()], schema)
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = stage(spark, docs, str(tmp_path))
    if name != "best_fit_packing":
        assert rows.columns == docs.columns
        assert all(r[c] == f"own {c} {r.doc_id}" for r in rows.collect() for c in INNER)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_registered(spark):
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


CONTRACT = {
    "op1": "doc_id held_out score predicted",
    "op2": "doc_id keep_id group_size kept text_sha256",
    "op3": "page_id url text n_chars",
    "op4": "doc_id n_shingles component_id",
    "op5": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6": "doc_id size text_crc32 law shard slot grown_shard",
    "op7": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9": "doc_id license share first_word last_word",
    "op10": "doc_id n_words n_removed kept_sha256",
    "op11": "lang rank phrase a l r n score",
    "op12": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
}
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_gives_every_row(spark, name):
    found = QUERIES[name](spark, FOLDER)
    op = name.split("_")[0]
    assert found.columns == CONTRACT[op].split()
    if op == "op11":
        ranks = {}
        for r in found.collect():
            ranks.setdefault(r.lang, []).append(r["rank"])
        assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())
        return
    key = found.columns[0]
    given = spark.read.parquet(f"{FOLDER}/{'pages' if op == 'op3' else 'documents'}.parquet")
    ids = [r[0] for r in found.select(key).collect()]
    if op == "op9":
        assert set(ids) <= {r[0] for r in given.select(key).collect()}
    else:
        assert set(ids) == {r[0] for r in given.select(key).collect()}
        assert op == "op8" or len(ids) == given.count()

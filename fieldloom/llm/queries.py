"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import alignment, collocations, exact, fingerprints, jaccard, licenses, packing, pieces, private, shards, substrings, toxicity, wordpieces, wrappers
from fieldloom.llm.stage import whole_text, written

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of the documents; no query needs more of them."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels that are not held out."""
    scored = toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays for it."""
    marked = exact.mark_duplicates(documents(spark, sf_dir))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    read = wrappers.extract_articles(pages)
    return read.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and the component of its links."""
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    encoded = pieces.encode(documents(spark, sf_dir), PIECE_MODEL, decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards by key, and where a seventeenth would take rows."""
    text = F.col("text").cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return shards.shard(rows, 16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch, its edited text's, and how alike they are."""
    rows = fingerprints.edited_pairs(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens."""
    cut = wordpieces.token_pieces(documents(spark, sf_dir), WORD_MODEL)
    narrow = written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license statement found in a document."""
    return licenses.scan_licenses(documents(spark, sf_dir), licenses.all_templates(), decide=True)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without those of passages that come earlier."""
    kept = substrings.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between byte-level tokens and pieces."""
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))
    rows = alignment.align_tokens(documents(spark, sf_dir), BYTE_MODEL, PIECE_MODEL, keep=digest)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = private.find_private(documents(spark, sf_dir))
    base = F.col("base_spans")
    return found.select(
        "doc_id",
        *(private.count_of(base, kind).alias(f"n_{kind}") for kind in private.KINDS),
        F.sha2(private.as_text(base).cast("binary"), 256).alias("base_sha256"),
        private.as_text(F.col("spans")).alias("spans"),
    )


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_html_extraction, op4_ngram_jaccard, op5_sentencepiece, op6_sharding, op7_fingerprints, op8_best_fit_packing, op9_license_scans, op10_substring_dedup, op11_phrase_collocations, op12_cross_tokenizer_alignment, op13_pii)}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
            FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
            FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id""",
    "op10_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) AS nth
            FROM w, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM s WHERE nth > 1),
        k AS (
            SELECT doc_id, string_agg(t.x, ' ' ORDER BY t.i) AS kept, count(*) AS n
            FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w) t ANTI JOIN c USING (doc_id, i)
            GROUP BY doc_id)
        SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
    "op11_phrase_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(
                regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
                lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS w
            FROM documents),
        g AS (
            SELECT lang, k AS size, w[i : i + k - 1] AS g, count(*) AS f
            FROM p, LATERAL (SELECT unnest([1, 2, 3]) AS k) s, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) t
            GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang),
        c AS (SELECT lang, size, g, f FROM g WHERE size > 1 AND f >= 10),
        i AS (
            SELECT lang, s, max(f) AS most
            FROM (SELECT lang, f, unnest([g[1:2], g[2:3]]) AS s FROM c WHERE size = 3) GROUP BY ALL),
        k AS (SELECT c.* FROM c LEFT JOIN i ON i.lang = c.lang AND i.s = c.g WHERE most IS NULL OR 100 * most < 50 * f),
        x AS (
            SELECT k.lang, k.g, k.f AS a, cut, l.f AS l, r.f AS r,
                   (1000000::HUGEINT * k.f * k.f // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM k, LATERAL (SELECT unnest(range(1, k.size)) AS cut) t
            JOIN g l ON l.lang = k.lang AND l.g = k.g[1:cut] JOIN g r ON r.lang = k.lang AND r.g = k.g[cut + 1:]),
        b AS (
            SELECT *, array_to_string(g, ' ') AS phrase FROM x
            QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
        SELECT o.lang, rank, phrase, a, l, r, n.n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000""",
}

"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
``documents``. ``run`` writes every stage's table to the shared folder and reads it back for the
next. No SQL gives the same rows: a classifier is trained, and packing is a heuristic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import exact, jaccard, packing, substrings, toxicity, wordpieces
from fieldloom.llm.stage import boxed, opened, written

ORACLE_SQL = None

# Columns the stages work on; a stage carries the others along untouched.
TAKEN = {"doc_id": "doc_id", "text": "text"}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier calls toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    clean = toxicity.toxicity(boxed(docs, **TAKEN), labels).where("predicted = 0")
    return clean.select(*opened(docs.columns, **TAKEN))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact.deduplicated(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies, the document with the least id."""
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"))
    staying = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_key")).distinct()
    kept = boxed(docs, **TAKEN).join(staying, F.col("doc_id").eqNullSafe(F.col("_key")), "left_semi")
    return kept.select(*opened(docs.columns, **TAKEN))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that come earlier; a document that loses none stays as it is."""
    clean = substrings.remove_repeats(boxed(docs, **TAKEN))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = clean.select("doc_id", text.alias("text"), "_rest", (F.col("n_removed") > 0).alias("_cut"))
    rows = changed.select(*opened(docs.columns, **TAKEN), "_cut")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_cut"), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    cut = wordpieces.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    narrow = written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(narrow)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact duplicates: combined in each task, by salted digest, then over salts, always on the full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.stage import boxed, opened, whole_text, written

SALTS = 16


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=text_digest, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: ``_digest, _text, keep_id`` (its largest key) and ``group_size``.

    The three stages group on digest and whole text, so texts that share a digest stay apart.
    Grouping combines inside each task before anything is sent, the salt (the task's number)
    spreads one text's partial rows over ``salts`` groups, and the last grouping sees at most
    ``salts`` rows of a text.
    """
    body = whole_text(text)
    rows = docs.select(
        F.col(key).alias("_key"),
        body.alias("_text"),
        digest(body).alias("_digest"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"),
    )
    salted = rows.groupBy("_digest", "_salt", "_text").agg(
        F.max("_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return salted.groupBy("_digest", "_text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def mark_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=text_digest, salts: int = SALTS) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts (null counts as empty) the row with the largest key stays. Rows that repeat
    key and text count in ``group_size`` and are all marked kept; null keys stay only if a text
    has no other key. The added columns replace columns of those names.

    Rows find their class by digest alone where the digest has one text, and by digest and whole
    text where it has several; the narrow first join moves no text.
    """
    new = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*new)
    found = classes(docs, key, text, digest, salts)
    # One row per digest; a digest of several texts is marked and left to the full comparison.
    digests = written(
        found.groupBy("_digest").agg(
            F.max("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
            F.count(F.lit(1)).alias("_texts"),
        )
    )
    body = whole_text(text)
    rows = docs.withColumns({"_digest": digest(body), "_sha256": text_digest(body)})
    joined = rows.join(digests.where("_texts = 1").drop("_texts"), "_digest")
    shared = digests.where("_texts > 1").select("_digest")
    if not shared.isEmpty():
        apart = found.join(shared, "_digest", "left_semi")
        again = rows.withColumn("_text", body).join(shared, "_digest", "left_semi").join(apart, ["_digest", "_text"]).drop("_text")
        joined = joined.unionByName(again)
    return joined.select(
        *[F.col(c) for c in docs.columns],
        "keep_id",
        "group_size",
        F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha256").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, once each: of equal texts the one with the largest key.

    Who stays is found on keys and digests; whole rows move once, by key, to meet that list.
    """
    marked = mark_duplicates(docs.select(key, text), key, text).where("kept")
    staying = marked.select(F.col(key).alias("_key"), F.col("text_sha256").alias("_own")).distinct()
    taken = {"_given": key, "_text": text}
    rows = boxed(docs, **taken).withColumn("_sha256", text_digest(whole_text("_text")))
    met = rows.join(staying, F.col("_given").eqNullSafe(F.col("_key")) & (F.col("_sha256") == F.col("_own")), "left_semi")
    return met.dropDuplicates(["_given", "_sha256"]).select(*opened(docs.columns, **taken))

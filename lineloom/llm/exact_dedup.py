"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import documents, small_side, text_of
from lineloom.session import materialize

#: Characters that the second stage hashes.
PREFIX_CHARS = 64


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: Sequence[Column] = ()) -> DataFrame:
    """One row per row of ``docs``: key, ``keep_id``, ``group_size``, ``kept`` and the carried columns.

    1. Rows are counted by text length in bytes; a length seen once ends there.
    2. The rest are counted by (length, hash of the first characters).
    3. Only rows of a (length, prefix) seen twice have their whole text hashed
       (SHA-256), and equal hashes form the groups.  Texts never enter a shuffle:
       the few surviving (length, prefix) pairs go to the texts when a count shows
       them small; beyond that every text is hashed where it is read.

    The row with the largest key stays.  A null text counts as empty.  Null keys are
    the smallest.  Rows equal in key and text are one group of which one row stays.
    An empty table gives no rows.  ``carry`` adds columns computed from ``docs``.
    """
    spark = docs.sparkSession
    body = text_of(text)
    size, head = F.octet_length(body).alias("size"), F.xxhash64(F.substring(body, 1, PREFIX_CHARS)).alias("head")
    lengths = docs.groupBy(size).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = docs.select(size, head).join(lengths.select("size"), "size", "left_semi")
    pairs = heads.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs, seen = materialize(
        pairs.select("size", "head", F.lit(True).alias("shared")), "exact-pairs", rows=F.count(F.lit(1))
    )
    rows = docs.select(F.col(key), *carry, size, head, body.alias("_body"))
    side = small_side(pairs, seen["rows"])
    whole = F.sha2("_body", 256)
    if side is pairs:
        hashed = rows.withColumn("full", whole).drop("_body").join(pairs, ["size", "head"], "left")
        hashed = hashed.withColumn("full", F.when(F.col("shared"), F.col("full")))
    else:
        hashed = rows.join(side, ["size", "head"], "left").withColumn("full", F.when(F.col("shared"), whole))
    names = [c for c in hashed.columns if c not in ("size", "head", "shared", "_body", "full")]
    hashed, _ = materialize(
        hashed.select(*names, "full", F.monotonically_increasing_id().alias("row")), "exact-hashed"
    )
    found = hashed.where("full IS NOT NULL")
    groups = found.groupBy("full").agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = found.join(groups.where("group_size > 1"), "full")
    best = joined.where(F.col(key).eqNullSafe(F.col("keep_id"))).groupBy("full").agg(F.min("row").alias("best"))
    copies = joined.join(best, "full").select(*names, "keep_id", "group_size", (F.col("row") == F.col("best")).alias("kept"))
    alone = hashed.where("full IS NULL").unionByName(
        found.join(groups.where("group_size = 1").select("full"), "full", "left_semi")
    )
    alone = alone.select(*names, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return copies.unionByName(alone)


def drop_exact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; keys must be unique to get whole rows back."""
    kept = exact_groups(docs, text, key).where("kept").select(F.col(key).alias("_keep"))
    return docs.join(kept, docs[key].eqNullSafe(F.col("_keep")), "left_semi")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    digest = F.sha2(text_of("text"), 256).alias("text_sha256")
    return exact_groups(docs, carry=[digest]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

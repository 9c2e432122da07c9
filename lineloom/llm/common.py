"""What several corpus operators share: reading, word patterns, stable hashing, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.session import materialize
from lineloom.sources.tables import table

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows a side may have to be sent to every executor; larger sides are shuffled.
BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(name: str) -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if the counted ``rows`` stay under the bound, else leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def most_frequent(counts: DataFrame, column: str, rows: int) -> DataFrame:
    """The rows of the greatest counts, at most ``rows`` of them.

    A histogram on sixteenths of a power of two finds the least count that keeps the bound, so nothing but
    its few hundred buckets and the chosen rows ever leaves the tasks.  Counts of one bucket are taken or left together.
    """
    bucket = F.floor(F.log2(F.col(column).cast("double")) * 16)
    sizes = counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["bucket"]):
        total += r["n"]
        if total > rows:
            break
        least = r["bucket"]
    return counts.where(F.lit(False)) if least is None else counts.where(bucket >= least)


def components(links: DataFrame, label: str) -> DataFrame:
    """``(node, root)`` for every end of ``links(a, b)``; root is the component's smallest node.

    Each round lets every node adopt the smallest label around it and then jumps
    to its label's label, so the rounds grow with the logarithm of the diameter.
    Rounds are written to the shared folder; nothing reaches the driver but the
    number of labels that changed.  No links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, _ = materialize(both, f"{label}-links")
    labels, seen = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")),
        f"{label}-labels",
        rows=F.count(F.lit(1)),
    )
    changed = seen["rows"]
    while changed:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("offer")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("offer").alias("offer"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "offer").alias("root")
        )
        roots = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        labels, seen = materialize(
            lower.join(roots, "root").select("node", "old", F.col("above").alias("root")),
            f"{label}-labels",
            changed=F.sum((F.col("old") != F.col("root")).cast("long")),
        )
        changed, labels = seen["changed"] or 0, labels.select("node", "root")
    return labels

"""A script corpus derived from a keyed table, with planted reading traps.

Each key ``k`` yields one script that reads the tables of keys ``k div 2`` and
``k div 3`` plus an outside table inside a CTE, so the expected graph follows
from arithmetic on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _spread(keys: DataFrame) -> DataFrame:
    """Even partitions of the keys: a file's splits may be empty but for one, and a key is tiny next to
    the script made from it.  Adaptive execution never merges partitions that were asked for by number."""
    cores = keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(max(cores, keys.rdd.getNumPartitions()))


def corpus(keys: DataFrame, key: str) -> DataFrame:
    """``scripts(path, content)`` with one script per key and a few copies."""
    k = F.col("k")
    a, b = F.expr("k div 2"), F.expr("k div 3")
    text = lambda c: c.cast("string")
    q = F.lit("'")

    base = _spread(keys.select(key)).select(F.col(key).cast("long").alias("k")).select(
        "k",
        F.concat(F.lit("t"), text(k)).alias("nm"),
        F.concat(F.lit("ds"), text(k % 7)).alias("ds"),
        F.concat(F.lit("t"), text(a)).alias("na"),
        F.concat(F.lit("ds"), text(a % 7), F.lit(".t"), text(a)).alias("ra"),
        F.concat(F.lit("t"), text(b)).alias("rb"),
        F.when(k % 4 == 0, "Bronze")
        .when(k % 4 == 1, "silver")
        .when(k % 4 == 2, "gold")
        .otherwise("misc")
        .alias("folder"),
    )
    query = F.concat(
        F.lit("WITH c1 AS (SELECT * FROM ext.e"), text(k % 50), F.lit(") SELECT a.id, "),
        q, F.lit("from fake_lit"), q,
        F.lit(" AS lit, EXTRACT(DAY FROM a.ts) AS d FROM "), F.col("ra"),
        F.lit(" a LEFT JOIN "), F.col("rb"),
        F.lit(" b ON a.id = b.id JOIN c1 ON a.id = c1.id"),
        F.when(k % 41 == 0, F.concat(F.lit(" JOIN "), F.col("na"), F.lit(" dup ON dup.id = a.id"))).otherwise(""),
        F.when(k % 53 == 0, F.concat(F.lit(" JOIN "), F.col("nm"), F.lit(" self ON self.id = a.id"))).otherwise(""),
        F.when(k == 3, " JOIN t7 cyc ON cyc.id = a.id").otherwise(""),
        F.when(k % 19 == 0, ", UNNEST(a.items) u").otherwise(""),
        F.lit(" WHERE a.k IN (1, 2)"),
    )
    created = F.concat(
        F.lit("-- from not_a_table\nCREATE OR REPLACE "),
        F.when(k % 3 == 0, "VIEW").otherwise("TABLE"),
        F.lit(" "), F.col("ds"), F.lit("."), F.col("nm"), F.lit(" AS "), query,
    )
    broken = F.concat(
        F.lit("CREATE OR REPLACE VIEW "), F.col("ds"), F.lit("."), F.col("nm"), F.lit(" AS (SELECT FROM")
    )
    main = base.select(
        F.concat(F.lit("wh/"), F.col("folder"), F.lit("/"), F.col("nm"), F.lit(".sql")).alias("path"),
        F.when(k % 97 == 0, broken).when(k % 13 == 0, query).otherwise(created).alias("content"),
    )
    copies = base.where(k % 101 == 0).select(
        F.concat(F.lit("wh/zz_copy/"), F.col("nm"), F.lit(".sql")).alias("path"),
        F.concat(F.lit("CREATE TABLE dup."), F.col("nm"), F.lit(" (id INT)")).alias("content"),
    )
    return main.unionByName(copies)

"""Stub scripts for tables nobody defines, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: text of a stub script; %s is the name of the missing table.
STUB = """-- Created automatically for %s

CREATE OR REPLACE TABLE `%s` AS
SELECT
    -- Add columns here
    1 as id
"""


def ghost_stub_sql(ghosts: DataFrame) -> DataFrame:
    """(path, content): where a missing table's script would go, and a first text.

    ``first.second[...]`` goes to ``first/second.sql``, a bare name to ``name.sql``.
    """
    parts = F.split("id", r"\.")
    path = F.concat(F.array_join(F.slice(parts, 1, 2), "/"), F.lit(".sql"))
    return ghosts.select(path.alias("path"), F.format_string(STUB, "id", "id").alias("content"))


def stub_admit(stubs: DataFrame, scripts: DataFrame) -> DataFrame:
    """(path, status): ``invalid path`` with '..', ``exists`` when taken, else ``ok``."""
    taken = scripts.select("path").distinct().withColumn("_taken", F.lit(True))
    status = (
        F.when(F.col("path").contains(".."), "invalid path")
        .when(F.col("_taken"), "exists")
        .otherwise("ok")
    )
    return stubs.select("path").join(taken, "path", "left").select("path", status.alias("status"))

"""Folder listing and selection over script paths relative to a root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions import naming


def folder_list(scripts: DataFrame) -> DataFrame:
    """Every folder that holds a script, directly or below, sorted.

    A folder whose name starts with a dot is left out with everything under it.
    """
    folders = scripts.select(naming.folder_of(F.col("path")).alias("f")).distinct()
    prefixes = folders.select(F.explode(naming.folder_prefixes(F.col("f"))).alias("folder"))
    shown = prefixes.where(~F.col("folder").rlike(r"(^|/)\."))
    return shown.distinct().orderBy("folder")


def folder_filter(scripts: DataFrame, folders: list[str] | DataFrame | None) -> DataFrame:
    """Scripts lying exactly in one of the folders.

    None keeps all scripts, an empty list keeps none, '' is the root.  Use
    ``folder_subtree_expand`` first to include sub-folders.
    """
    if folders is None:
        return scripts
    own = naming.folder_of(F.col("path"))
    if isinstance(folders, DataFrame):
        return scripts.join(
            folders.select(F.col("folder").alias("_f")), own == F.col("_f"), "left_semi"
        )
    return scripts.where(own.isin(list(folders)))


def folder_subtree_expand(folders: DataFrame, picked: DataFrame) -> DataFrame:
    """Picked folders and all their descendants.

    Each folder is spread into its own prefixes, which turns "is below" into an
    equality join; the number of prefixes is the folder's depth.
    """
    spread = folders.select(
        "folder", F.explode(naming.folder_prefixes(F.col("folder"))).alias("prefix")
    )
    chosen = picked.select(F.col("folder").alias("prefix")).distinct()
    return spread.join(chosen, "prefix", "left_semi").select("folder").distinct()


def layer_classify(scripts: DataFrame) -> DataFrame:
    return scripts.select("path", naming.layer_of(F.col("path")).alias("layer"))


def alias_table(spark) -> DataFrame:
    return spark.createDataFrame(
        list(naming.LAYER_ALIASES), "alias string, layer string, priority int"
    )


def layer_alias_classify(scripts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Layer by the documented folder aliases; the lowest priority number wins.

    ``aliases(alias, layer, priority)`` is a small naming convention; distinct
    folders are classified once and joined back, so the work per script is one
    equality join.
    """
    own = naming.folder_of(F.col("path"))
    segments = (
        scripts.select(own.alias("folder"))
        .distinct()
        .select("folder", F.explode(F.split(F.lower("folder"), "/")).alias("alias"))
    )
    best = (
        segments.join(aliases, "alias")
        .groupBy("folder")
        .agg(F.min_by("layer", "priority").alias("layer"))
    )
    return (
        scripts.withColumn("folder", own)
        .join(best, "folder", "left")
        .select("path", F.coalesce("layer", F.lit("other")).alias("layer"))
    )

"""Saving and loading named graphs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.sources import versions

METADATA_SCHEMA = "key string, value string"
DEFAULT_NAME = "sql_diagram"
PARTS = ("nodes", "edges", "metadata")


def _place(base: str, name: str) -> str:
    if not name or "/" in name or ".." in name:
        raise ValueError(f"bad snapshot name {name!r}")
    return f"{base.rstrip('/')}/{name}"


def snapshot_save(
    base: str,
    nodes: DataFrame,
    edges: DataFrame,
    metadata: dict | None = None,
    name: str = DEFAULT_NAME,
    fmt: str = "parquet",
) -> None:
    """Write a graph under ``base/name`` as its new version.

    Nodes, edges and metadata become current together, after all three are written.  They may
    derive from the snapshot that they replace, and a failed save leaves it as it was.
    Metadata values are stored as JSON text.  ``fmt`` is ``parquet`` or ``json``.
    """
    spark, place = nodes.sparkSession, _place(base, name)
    data = versions.new_version(place)
    rows = [(k, json.dumps(v)) for k, v in (metadata or {}).items()]
    meta = spark.createDataFrame(rows, METADATA_SCHEMA).coalesce(1)
    for part, df in zip(PARTS, (nodes, edges, meta)):
        df.write.format(fmt).save(f"{data}/{part}")
    versions.publish(spark, place, data)


def snapshot_load(
    spark: SparkSession,
    base: str,
    part: str,
    schema: str,
    name: str = DEFAULT_NAME,
    fmt: str = "parquet",
) -> DataFrame:
    """Read ``nodes``, ``edges`` or ``metadata`` of the current version; empty when never saved."""
    data = versions.current(spark, _place(base, name))
    if data is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(f"{data}/{part}")


def snapshot_list(spark: SparkSession, base: str) -> DataFrame:
    """(name, version, saved): every graph saved under ``base``, its newest version and when that was finished.

    Read from the version markers alone; a save that never finished is not there.  The driver lists the names.
    """
    root = base.rstrip("/")
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for folder in fs.listStatus(where) if fs.exists(where) else []:
        name = folder.getPath().getName()
        found = versions.versions(spark, f"{root}/{name}") if folder.isDirectory() else []
        if found:
            number, data = found[-1]
            marker = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{number:012d}-{data}.version")
            rows.append((name, number, fs.getFileStatus(marker).getModificationTime()))
    saved = spark.createDataFrame(rows, "name string, version long, millis long")
    return saved.select("name", "version", F.timestamp_millis("millis").alias("saved"))


def metadata_of(spark: SparkSession, base: str, name: str = DEFAULT_NAME, fmt: str = "parquet") -> dict:
    """The handful of settings saved with a graph."""
    rows = snapshot_load(spark, base, "metadata", METADATA_SCHEMA, name, fmt)
    return {r["key"]: json.loads(r["value"]) for r in rows.select("key", "value").toLocalIterator()}

"""A stored graph that follows its scripts: only what changed is parsed, resolved and counted again."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lineloom.functions.naming import file_base
from lineloom.operators import closure, condense, graph
from lineloom.operators.parse import LIGHT, last_definition_wins, parse_scripts, table_refs
from lineloom.session import materialize
from lineloom.sources import versions

_RECORD = ", ".join(f"{c} array<string>" if c == "dependencies" else f"{c} string" for c in LIGHT)
_NODE = ", ".join(f"{c} string" for c in graph.NODE)
#: The parts of a stored graph.
PARTS = {
    "scripts": f"digest string, {_RECORD}",
    "records": _RECORD,
    "resolved": "id string, dep string, kind string, node_id string",
    "edges": ", ".join(f"{c} string" for c in graph.EDGE),
    "nodes": f"{_NODE}, direct_count int, nested_count bigint",
}
_SETTINGS = "settings string"


@dataclass(frozen=True)
class Refreshed:
    """The graph after a refresh, and what the refresh had to do: scripts and characters parsed, records resolved, nodes counted."""

    nodes: DataFrame
    edges: DataFrame
    parsed: int
    chars: int
    resolved: int
    counted: int


def graph_load(spark: SparkSession, place: str, part: str) -> DataFrame:
    """A part of the stored graph as it is now; empty when nothing was stored."""
    data = versions.current(spark, place)
    return spark.createDataFrame([], PARTS[part]) if data is None else spark.read.schema(PARTS[part]).parquet(f"{data}/{part}")


def _same_settings(spark: SparkSession, place: str, settings: str) -> bool:
    data = versions.current(spark, place)
    return data is not None and spark.read.schema(_SETTINGS).parquet(f"{data}/settings").first()["settings"] == settings


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "id", "left_anti")


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "id", "left_semi")


def _counts(edges: DataFrame, ids: DataFrame, sub: DataFrame) -> DataFrame:
    """(id, direct_count, nested_count) of ``ids``; ``sub`` has every edge above them."""
    direct = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("direct"))
    nested = condense.acyclic(sub).counts("node").withColumnRenamed("n", "nested")
    joined = ids.join(_only(direct, ids), "id", "left").join(_only(nested, ids), "id", "left")
    return joined.select("id", F.coalesce("direct", F.lit(0)).cast("int").alias("direct_count"), F.coalesce("nested", F.lit(0)).alias("nested_count"))


def refresh(
    scripts: DataFrame,
    place: str,
    dialect: str = "bigquery",
    discovery: bool = True,
    match: str = "bare",
    root: str = "",
    aliases: bool = False,
) -> Refreshed:
    """Bring the graph stored at ``place`` up to date with ``scripts(path, content)``; the first time, build it.

    The result is the graph that ``full_graph`` would give.  One row per path is expected; a null text counts as empty.

    1. Paths and digests of the texts are compared with the stored ones.  Only new and changed texts are parsed; of
       texts only these ever meet a join.
    2. Ids of changed files get their record anew (another file of that name may win).  Names that now mean another
       record are found among the names of those records, old and new.
    3. Records that changed, and records that read a name that means another record now, are resolved again.
    4. Targets whose edges differ, and all below them, are counted again, on the edges above them only.

    All parts become current together, as a new version; readers of the old one keep it, and a failed refresh
    changes nothing.  Without changes no version is made.  A place stored with other settings is built anew.
    """
    spark = scripts.sparkSession
    settings = json.dumps([dialect, discovery, match, root, aliases])
    known = _same_settings(spark, place, settings)
    old = {part: graph_load(spark, place, part) if known else spark.createDataFrame([], schema) for part, schema in PARTS.items()}
    data = versions.new_version(place)

    def keep(df: DataFrame, part: str) -> DataFrame:
        df.write.parquet(f"{data}/{part}")
        return spark.read.schema(df.schema).parquet(f"{data}/{part}")

    stamps = scripts.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    both = stamps.join(old["scripts"].select("path", F.col("digest").alias("before")), "path", "full")
    delta = both.where(~F.col("digest").eqNullSafe(F.col("before"))).select("path", "digest")
    delta, seen = materialize(delta, "delta", n=F.count(F.lit(1)))
    if known and not seen["n"]:
        return Refreshed(old["nodes"], old["edges"], 0, 0, 0, 0)
    probe = Observation()
    texts = scripts.join(delta.where("digest IS NOT NULL").select("path"), "path", "left_semi") if known else scripts
    texts = texts.observe(probe, F.count(F.lit(1)).alias("n"), F.sum(F.char_length("content")).alias("chars"))
    parsed, _ = materialize(parse_scripts(texts, dialect, match, LIGHT, root, aliases), "parsed")
    files = old["scripts"].join(delta.select("path"), "path", "left_anti").unionByName(parsed.join(delta, "path"))
    files = keep(files.select("digest", *LIGHT), "scripts")

    ids, _ = materialize(delta.select(file_base(F.col("path")).alias("id")).distinct(), "ids")
    renewed, _ = materialize(last_definition_wins(_only(files.select(*LIGHT), ids)), "renewed")
    records = keep(_without(old["records"], ids).unionByName(renewed), "records")

    names = graph.record_names(_only(old["records"], ids)).unionByName(graph.record_names(renewed)).select("name").distinct()
    names, _ = materialize(names, "names")
    before = graph.name_lookup(old["records"], names).withColumnRenamed("node_id", "was")
    moved = graph.name_lookup(records, names).join(before, "name", "full").where(~F.col("node_id").eqNullSafe(F.col("was")))
    readers = graph.names_looked_up(old["resolved"]).join(moved.select("name"), "name", "left_semi").select("id")
    touched, seen = materialize(ids.union(readers).distinct(), "touched", n=F.count(F.lit(1)))
    refs, _ = materialize(table_refs(_only(records, touched)), "refs")
    again = graph.resolve(refs, graph.name_lookup(records, graph.names_looked_up(refs).select("name").distinct()))
    resolved = keep(_without(old["resolved"], touched).unionByName(again), "resolved")

    nodes, edges = graph.discovery_graph(records, resolved, discovery)
    edges = keep(edges, "edges")
    if known:
        into = touched.withColumnRenamed("id", "target")
        now, then = (e.select(*graph.EDGE).join(into, "target", "left_semi") for e in (edges, old["edges"]))
        differ = now.exceptAll(then).union(then.exceptAll(now)).select(F.col("target").alias("id")).distinct()
        below = closure.reached(edges, differ, up=False).select("id")
        counted, n = materialize(below, "below", n=F.count(F.lit(1)))
        above = closure.reached(edges, counted, down=False).select(F.col("id").alias("target"))
        counts = _counts(edges, counted, edges.join(above, "target", "left_semi"))
    else:
        counted, n = materialize(nodes.select("id"), "below", n=F.count(F.lit(1)))
        counts = _counts(edges, counted, edges)
    numbers = [c for c in counts.columns if c != "id"]
    counts = _without(old["nodes"].select("id", *numbers), counted).unionByName(counts)
    table = nodes.join(counts, "id", "left").select(*graph.NODE, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
    table = keep(table, "nodes")
    spark.createDataFrame([(settings,)], _SETTINGS).coalesce(1).write.parquet(f"{data}/settings")
    versions.publish(spark, place, data)
    return Refreshed(table, edges, probe.get["n"], probe.get["chars"] or 0, seen["n"], n["n"])

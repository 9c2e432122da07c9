"""Parsed records -> nodes and edges of the lineage graph.

Join sides that are looked up (name -> node, node -> layer) are unique on their
key, so a name that a third of all scripts read only makes the *probing* side
heavy.  That side is the outer side of the join, which adaptive execution can
split, and nothing is broadcast by hint: a lookup is broadcast only when its
measured size is under the session's threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions.naming import last_part
from lineloom.operators.closure import Closure
from lineloom.operators.condense import Acyclic

NODE = ("id", "label", "layer", "type", "project", "dataset", "path")
EDGE = ("edge_id", "source", "target", "kind")

# Prefix for join keys that must match nothing but still spread evenly.
_NO_MATCH = "\u0000"


def record_names(parsed: DataFrame) -> DataFrame:
    """(id, path, name): every name under which each record can be referred to."""
    label, dataset, project = F.col("label"), F.col("dataset"), F.col("project")
    in_dataset = dataset != "default"
    names = F.array(
        F.col("id"),
        label,
        F.when(in_dataset, F.concat_ws(".", dataset, label)),
        F.when(in_dataset & (project != "default"), F.concat_ws(".", project, dataset, label)),
    )
    return parsed.select("id", "path", F.explode(F.array_distinct(F.array_compact(names))).alias("name"))


def name_lookup(parsed: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(name, node_id): the names under which each record can be referred to, or those of them in ``wanted(name)``.

    Of several records with one name, the one with the greatest path wins.
    """
    names = record_names(parsed)
    if wanted is not None:
        names = names.join(wanted, "name", "left_semi")
    return names.groupBy("name").agg(F.max_by("id", "path").alias("node_id"))


def names_looked_up(deps: DataFrame) -> DataFrame:
    """(id, name): the names that ``resolve`` may look up for each record's dependencies."""
    short = last_part(F.col("dep"))
    return deps.where("kind = 'table'").select("id", F.explode(F.array_distinct(F.array("dep", short))).alias("name"))


def resolve(deps: DataFrame, lookup: DataFrame) -> DataFrame:
    """``deps`` plus ``node_id``: by exact name, else by the last dotted part.

    Distinct names are resolved once and joined back, so a popular name costs
    one lookup instead of one per script that reads it.
    """
    names = deps.where("kind = 'table'").select("dep").distinct()
    exact = names.join(lookup.select(F.col("name").alias("dep"), F.col("node_id").alias("exact")), "dep", "left")
    # Names already resolved take a key that matches nothing; a null key would
    # send all of them to one partition.
    retry = F.col("exact").isNull() & F.col("dep").contains(".")
    keyed = exact.withColumn(
        "short", F.when(retry, last_part(F.col("dep"))).otherwise(F.concat(F.lit(_NO_MATCH), F.col("dep")))
    )
    found = keyed.join(
        lookup.select(F.col("name").alias("short"), F.col("node_id").alias("loose")), "short", "left"
    ).select("dep", F.coalesce("exact", "loose").alias("node_id"))
    return deps.join(found, "dep", "left").select("id", "dep", "kind", "node_id")


def _edges(pairs: DataFrame, source: str, kind) -> DataFrame:
    return pairs.select(
        F.concat_ws("-", F.col(source), F.col("id")).alias("edge_id"),
        F.col(source).alias("source"),
        F.col("id").alias("target"),
        kind.alias("kind"),
    )


def edge_resolve(resolved: DataFrame) -> DataFrame:
    """Edges between records; an edge to oneself is dropped, repeats are kept."""
    return _edges(resolved.where("node_id IS NOT NULL AND node_id <> id"), "node_id", F.lit("resolved"))


def _unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("kind = 'table' AND node_id IS NULL")


def ghost_nodes(resolved: DataFrame) -> DataFrame:
    """One node per name nobody defines."""
    parts = F.split("id", r"\.")
    short = F.size(parts).isin(2, 3)
    ghosts = _unresolved(resolved).select(F.col("dep").alias("id")).distinct()
    return ghosts.select(
        "id",
        F.when(short, F.element_at(parts, -1)).otherwise(F.col("id")).alias("label"),
        F.lit("external").alias("layer"),
        F.lit("table").alias("type"),
        F.when(F.size(parts) == 3, F.get(parts, F.lit(0))).otherwise("default").alias("project"),
        F.when(short, F.element_at(parts, -2)).otherwise("default").alias("dataset"),
        F.lit("discovered").alias("path"),
    )


def ghost_edges(resolved: DataFrame) -> DataFrame:
    return _edges(_unresolved(resolved), "dep", F.lit("external"))


def _cte_name(dep, owner):
    """``cte:<file>:<name>`` without its first two parts."""
    return F.substr(dep, F.length(owner) + F.lit(len("cte:") + 2))


def cte_nodes(deps: DataFrame) -> DataFrame:
    """One node per CTE a script reads."""
    ctes = deps.where("kind = 'cte'").select("id", "dep")
    return ctes.select(
        F.col("dep").alias("id"),
        _cte_name(F.col("dep"), F.col("id")).alias("label"),
        F.lit("cte").alias("layer"),
        F.lit("cte").alias("type"),
        F.lit("internal").alias("project"),
        F.lit("cte").alias("dataset"),
        F.lit("internal").alias("path"),
    )


def cte_contents(parsed: DataFrame) -> DataFrame:
    """(id, content) of the CTE nodes: the body, or a comment naming the CTE."""
    dep = F.col("dep")
    name = _cte_name(dep, F.col("id"))
    return (
        parsed.select("id", "ctes", F.explode("dependencies").alias("dep"))
        .where(dep.startswith("cte:"))
        .select(
            dep.alias("id"),
            F.coalesce(F.try_element_at("ctes", name), F.concat(F.lit("-- CTE: "), name)).alias("content"),
        )
    )


def cte_edges(deps: DataFrame) -> DataFrame:
    return _edges(deps.where("kind = 'cte'"), "dep", F.lit("cte"))


def discovery_graph(
    parsed: DataFrame, resolved: DataFrame, discovery: bool
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); with discovery, also names nobody defines and CTEs.

    All edges come from one projection of the resolved dependencies.
    """
    nodes = parsed.select(*NODE)
    if not discovery:
        return nodes, edge_resolve(resolved)
    found = F.col("node_id").isNotNull()
    edges = _edges(
        resolved.where("node_id IS NULL OR node_id <> id").withColumn(
            "src", F.coalesce("node_id", "dep")
        ),
        "src",
        F.when(F.col("kind") == "cte", "cte").when(found, "resolved").otherwise("external"),
    )
    return nodes.unionByName(ghost_nodes(resolved)).unionByName(cte_nodes(resolved)), edges


def direct_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming edges per node, repeats counted, 0 where there are none."""
    counts = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def node_table(nodes: DataFrame, edges: DataFrame, closed: Closure | Acyclic) -> DataFrame:
    """Nodes with both counts, each joined straight onto the nodes."""
    direct = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("direct"))
    nested = closed.counts("node").withColumnRenamed("n", "nested")
    joined = nodes.join(direct, "id", "left").join(nested, "id", "left")
    return joined.select(
        *nodes.columns,
        F.coalesce("direct", F.lit(0)).cast("int").alias("direct_count"),
        F.coalesce("nested", F.lit(0)).alias("nested_count"),
    )


# Fixed value: the text of a node that no script defines.
GHOST_TEXT = "-- Discovered dependency"


def node_details(nodes: DataFrame, parsed: DataFrame) -> DataFrame:
    """(id, content, dependencies, ctes, error) of every node, joined on demand.

    Script text stays out of the graph and is only read here.  ``parsed`` has one record per id with all columns.
    A name that nobody defines has the fixed text; a CTE has its body.
    """
    kept = parsed.select("id", "content", "dependencies", "ctes", "error")
    texts = cte_contents(parsed).select("id", F.col("content").alias("_body"))
    joined = nodes.select("id", "layer").join(kept, "id", "left").join(texts, "id", "left")
    return joined.select(
        "id",
        F.when(F.col("layer") == "external", F.lit(GHOST_TEXT)).otherwise(F.coalesce("content", "_body")).alias("content"),
        F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"),
        F.coalesce("ctes", F.create_map().cast("map<string,string>")).alias("ctes"),
        "error",
    )

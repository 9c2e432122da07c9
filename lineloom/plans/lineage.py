"""Composed plans: from scripts to a finished graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lineloom.operators import closure, condense, graph
from lineloom.operators.folders import folder_filter
from lineloom.operators.parse import LIGHT, last_definition_wins, parse_scripts, table_refs
from lineloom.session import materialize


@dataclass(frozen=True)
class Lineage:
    """A resolved graph; every field is a DataFrame."""

    parsed: DataFrame
    nodes: DataFrame
    edges: DataFrame


def records(
    scripts: DataFrame,
    dialect: str = "bigquery",
    match: str = "bare",
    columns: tuple[str, ...] = LIGHT,
    root: str = "",
    aliases: bool = False,
) -> DataFrame:
    """One record per id; without the script text unless asked for.

    ``root`` and ``aliases`` choose how layers are read, as in ``parse_scripts``.
    """
    return last_definition_wins(parse_scripts(scripts, dialect, match, columns, root, aliases))


def stored_records(
    scripts: DataFrame, dialect: str = "bigquery", match: str = "bare", root: str = "", aliases: bool = False
) -> DataFrame:
    """The records a graph needs, written once.

    Nodes, names and dependencies all read them, and the optimizer gives each
    reader its own copy of the plan; stored, the texts are scanned once and
    only short columns move.
    """
    return materialize(records(scripts, dialect, match, root=root, aliases=aliases), "records")[0]


def resolved_deps(parsed: DataFrame) -> DataFrame:
    return graph.resolve(table_refs(parsed), graph.name_lookup(parsed))


def lineage(
    scripts: DataFrame,
    folders: list[str] | DataFrame | None = None,
    dialect: str = "bigquery",
    discovery: bool = False,
    match: str = "bare",
    root: str = "",
    aliases: bool = False,
) -> Lineage:
    """Nodes and edges of the selected folders' scripts."""
    parsed = stored_records(folder_filter(scripts, folders), dialect, match, root, aliases)
    resolved = resolved_deps(parsed)
    if discovery:
        resolved, _ = materialize(resolved, "resolved")
    nodes, edges = graph.discovery_graph(parsed, resolved, discovery)
    return Lineage(parsed, nodes, edges)


def full_graph(
    scripts: DataFrame,
    folders: list[str] | DataFrame | None = None,
    dialect: str = "bigquery",
    discovery: bool = False,
    match: str = "bare",
    max_depth: int | None = None,
    root: str = "",
    aliases: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(nodes with direct and nested counts, edges); with ``max_depth`` only ancestors within it are counted."""
    g = lineage(scripts, folders, dialect, discovery, match, root, aliases)
    edges, _ = materialize(g.edges, "edges")
    closed = condense.acyclic(edges) if max_depth is None else closure.closure(edges, max_depth)
    return graph.node_table(g.nodes, edges, closed), edges


def lineage_action(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, action: str) -> DataFrame:
    """The four actions on seed nodes.

    ``hide`` and ``hideTree`` and ``onlyTree`` give the ids to hide,
    ``selectTree`` every node with ``selected``.
    """
    if action == "hide":
        return seeds.select("id").distinct()
    if action == "hideTree":
        return closure.upstream_tree(edges, seeds)
    if action == "onlyTree":
        return closure.focus_tree(nodes, edges, seeds)
    if action == "selectTree":
        return closure.select_tree(nodes, edges, seeds)
    raise ValueError(f"unknown action {action!r}")

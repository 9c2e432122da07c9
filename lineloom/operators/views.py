"""Per-node and per-edge views of a graph: visibility, roles, search, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_nodes(nodes: DataFrame, layers_on: list[str], hidden: DataFrame) -> DataFrame:
    """(id, hidden): hidden when the layer is off or the id is in ``hidden(id)``.

    A missing layer counts as ``other``.
    """
    off = ~F.coalesce("layer", F.lit("other")).isin(list(layers_on))
    by_hand = hidden.select("id").distinct().withColumn("_h", F.lit(True))
    return nodes.join(by_hand, "id", "left").select("id", (off | F.col("_h").isNotNull()).alias("hidden"))


def edge_role(edges: DataFrame, node_id: str) -> DataFrame:
    """Role of each edge for one selected node; incoming is tested first."""
    role = (
        F.when(F.col("target") == node_id, "incoming")
        .when(F.col("source") == node_id, "outgoing")
        .otherwise("other")
    )
    return edges.select("edge_id", "source", "target", role.alias("role"))


def node_search(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes whose label contains the term, ignoring case."""
    return nodes.where(F.lower("label").contains(term.lower()))


def node_groups(nodes: DataFrame) -> DataFrame:
    """(grp, id, label, n) sorted by group and label; n is the group's size.

    There are at most three groups, so their sizes are counted with partial
    aggregation and the three-row result is broadcast; a window over the groups
    would put a third of all nodes into one task.
    """
    grp = (
        F.when((F.col("type") == "cte") | (F.col("layer") == "cte"), "cte")
        .when(F.col("layer") == "external", "external")
        .otherwise("standard")
    )
    grouped = nodes.select(grp.alias("grp"), "id", "label")
    sizes = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return (
        grouped.join(F.broadcast(sizes), "grp")
        .select("grp", "id", "label", "n")
        .orderBy("grp", "label", "id")
    )


def source_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): nodes nothing flows into."""
    return nodes.select("id").join(edges.select(F.col("target").alias("id")).distinct(), "id", "left_anti")


def carry_positions(nodes: DataFrame, previous: DataFrame) -> DataFrame:
    """Nodes with the x and y they had before, (0, 0) for new ones.

    ``previous(id, x, y)`` has one row per id.
    """
    return nodes.join(previous.select("id", "x", "y"), "id", "left").select(
        *[F.col(c) for c in nodes.columns],
        F.coalesce("x", F.lit(0.0)).alias("x"),
        F.coalesce("y", F.lit(0.0)).alias("y"),
    )

"""Checks over a finished graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.operators.closure import Closure, descendant_count
from lineloom.operators.condense import Acyclic

# Order of the layers from raw to serving.
LAYER_RANK = {"bronze": 1, "silver": 2, "gold": 3}


def audit_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): nodes with no edge in or out."""
    touched = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.select("id").join(touched, "id", "left_anti")


def audit_cycles(closed: Closure | Acyclic) -> DataFrame:
    """(id): nodes that reach themselves."""
    return closed.looped()


def audit_impact(nodes: DataFrame, closed: Closure | Acyclic) -> DataFrame:
    """(id, n): distinct nodes that depend on each node, 0 where none does."""
    return descendant_count(nodes, closed)


def with_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the layer of both ends; repeated edges are joined once."""
    layer = nodes.select("id", "layer")
    counted = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    source = layer.select(F.col("id").alias("source"), F.col("layer").alias("source_layer"))
    target = layer.select(F.col("id").alias("target"), F.col("layer").alias("target_layer"))
    return counted.join(source, "source").join(target, "target")


def _rank(layer: Column) -> Column:
    out = None
    for name, rank in LAYER_RANK.items():
        out = F.when(layer == name, rank) if out is None else out.when(layer == name, rank)
    return out


def audit_layer_jumps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between ranked layers that skip a layer or go backwards."""
    step = _rank(F.col("target_layer")) - _rank(F.col("source_layer"))
    return (
        with_layers(nodes, edges)
        .withColumn("step", step)
        .where(~F.col("step").isin(0, 1))
        .select("source", "target", "source_layer", "target_layer", "step")
    )


def audit_layer_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges, repeats counted, per source layer and target layer."""
    return (
        with_layers(nodes, edges)
        .groupBy("source_layer", "target_layer")
        .agg(F.sum("n").alias("n"))
    )

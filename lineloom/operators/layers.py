"""Links taken off a graph from its dead ends inwards, so that what follows from sources is made once per node.

A node that nothing leaves any more goes with all links into it.  In a graph that fans out, each turn takes a good part of what
is left, so few turns leave a small core that may hold cycles.  What a peeled node gets from its sources, all of which
went later or stayed, is then made in the reverse order, from finished sources only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.operators.condense import HUB, rows, union
from lineloom.session import discard, materialize

#: Turns of one job; they pay while a job takes most of the links, down to a core of at most ``CORE`` links.
TURNS, CORE = 2, 50_000


@dataclass(frozen=True)
class Peeled:
    """``layers[i]`` holds the links ``(source, target)`` that go in turn i + 1, ``core`` those that stay."""

    layers: list[DataFrame]
    core: DataFrame
    tables: list[DataFrame]

    def discard(self) -> None:
        discard(*self.tables)


def peel(links: DataFrame, count: int) -> Peeled:
    """``links(source, target)`` without repeats, ``count`` of them, by the turn in which their target goes."""
    left, layers, tables = links.select("source", "target"), [], []
    while count > CORE:
        tagged = left.withColumn("turn", F.lit(0))
        for k in range(1, TURNS + 1):
            exited = tagged.where("turn = 0").select(F.col("source").alias("target")).distinct().withColumn("on", F.lit(True))
            turn = F.when((F.col("turn") == 0) & F.col("on").isNull(), k).otherwise(F.col("turn"))
            tagged = tagged.join(exited, "target", "left").select("source", "target", turn.alias("turn"))
        whole, seen = materialize(tagged, "peeled", left=F.count_if(F.col("turn") == 0))
        if 2 * (seen["left"] or 0) > count:
            discard(whole)
            break
        layers += [whole.where(F.col("turn") == k).select("source", "target") for k in range(1, TURNS + 1)]
        left, count = whole.where("turn = 0").select("source", "target"), seen["left"]
        tables.append(whole)
    return Peeled(layers, left, tables)


def ranked_down(peeled: Peeled, known: DataFrame) -> list[DataFrame]:
    """``known(node, rank)`` of the core and, group by group, of the peeled nodes: the longest walk that ends at each.

    A source without a rank is one that nothing enters.
    """
    found = [known]
    for at in range(len(peeled.layers), 0, -TURNS):
        fresh = []
        for links in reversed(peeled.layers[at - TURNS : at]):
            there = union([*found, *fresh]).select(F.col("node").alias("source"), "rank")
            longest = F.max(F.coalesce("rank", F.lit(0).cast("long")) + 1)
            fresh.append(links.join(there, "source", "left").groupBy(F.col("target").alias("node")).agg(longest.alias("rank")))
        found.append(materialize(union(fresh), "rank")[0])
    return found


def part_of(member: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(member), F.lit(parts)).cast("int")


def as_sets(pairs: DataFrame, parts: int) -> DataFrame:
    """``(node, part, members)`` of ``pairs(node, member)`` without repeats."""
    return pairs.groupBy("node", part_of("member", parts).alias("part")).agg(F.collect_list("member").alias("members"))


def sets_down(peeled: Peeled, known: DataFrame, parts: int, sources: bool) -> list[DataFrame]:
    """``known(node, part, members)`` and a table of each layer: what the sources of its nodes have, and with ``sources`` these themselves.

    A node may stand in ``known`` and in a layer; both then go on to its targets.  Members are spread over ``parts`` by a hash.  The last
    layer's table, the widest, is read by nobody here and not written.
    """
    entered = union(peeled.layers).groupBy("target").agg(rows().alias("n")).where(F.col("n") > HUB).select(F.col("target").alias("node"))
    wide, seen = materialize(entered, "wide", n=rows())
    found = [known]
    for turn in range(len(peeled.layers), 0, -1):
        links = peeled.layers[turn - 1]
        there = union(found).select(F.col("node").alias("source"), "part", "members")
        come = links.join(there, "source").select(F.col("target").alias("node"), "part", "members")
        if sources:
            come = come.unionByName(links.select(F.col("target").alias("node"), part_of("source", parts).alias("part"), F.array("source").alias("members")))
        if seen["n"]:
            # A node that many enter tells its members apart before it gathers them.
            apart = come.join(wide, "node", "left_semi").select("node", "part", F.explode("members").alias("member")).distinct()
            apart = apart.groupBy("node", "part").agg(F.collect_list("member").alias("members"))
            come = come.join(wide, "node", "left_anti").unionByName(apart)
        made = come.groupBy("node", "part").agg(F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"))
        found.append(materialize(made, "sets")[0] if turn > 1 else made)
    return found

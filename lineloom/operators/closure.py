"""Transitive operators: loops of Spark jobs, one written table per round.

Only a row count crosses to the driver each round.  Every round's result is a
Parquet table in the shared folder, so plans stay short and a lost executor
costs at most one round.

Names are replaced by 8-byte keys before the closure is built: its pairs far
outnumber the nodes, so the name of a node should not travel with each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.operators.condense import PART, Acyclic, condensed, fold, numbered, ranks, rows, union
from lineloom.operators.layers import TURNS, as_sets, peel, ranked_down, sets_down
from lineloom.session import discard, materialize


@dataclass(frozen=True)
class Closure:
    """All ancestor pairs of a graph, by key.

    ``keys(id, key)`` names the keys; ``pairs(node, anc, dist)`` holds each
    ancestor of each node once with its distance.  ``(n, n)`` marks a node on a
    cycle.
    """

    keys: DataFrame
    pairs: DataFrame

    def named(self) -> DataFrame:
        """(node, anc, dist) with names."""
        node = self.keys.select(F.col("key").alias("node"), F.col("id").alias("node_id"))
        anc = self.keys.select(F.col("key").alias("anc"), F.col("id").alias("anc_id"))
        return (
            self.pairs.join(node, "node")
            .join(anc, "anc")
            .select(F.col("node_id").alias("node"), F.col("anc_id").alias("anc"), "dist")
        )

    def counts(self, by: str) -> DataFrame:
        """(id, n): other nodes paired with each node on side ``by``.

        Counted per key with partial aggregation; only one row per node is named.
        """
        per_key = (
            self.pairs.where("node <> anc").groupBy(F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        )
        return per_key.join(self.keys, "key").select("id", "n")

    def looped(self) -> DataFrame:
        """(id): nodes that reach themselves."""
        return self.pairs.where("node = anc").select(F.col("node").alias("key")).join(self.keys, "key").select("id")


def _keyed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``keys(id, key)``, the distinct edges as (node, anc), and the written table behind them.

    Keys are made while the distinct names are written, so they are unique by
    construction and fixed from then on.
    """
    links, _ = materialize(edges.select("source", "target").distinct(), "links")
    ids = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    keys, _ = materialize(ids.select("id", F.monotonically_increasing_id().alias("key")), "keys")
    source = keys.select(F.col("id").alias("source"), F.col("key").alias("anc"))
    target = keys.select(F.col("id").alias("target"), F.col("key").alias("node"))
    return keys, links.join(source, "source").join(target, "target").select("node", "anc"), links


def closure(edges: DataFrame, max_depth: int | None = None) -> Closure:
    """Every ancestor of every node.

    Distances double per round: a walk longer than ``d`` starts with a walk of
    exactly ``d``, so pairs at distance exactly ``d`` joined with all known
    pairs reach every distance up to ``2d``.  A graph of depth D takes about
    log2(D) rounds and stops on cycles by itself.  ``max_depth`` limits the
    distance on request.
    """
    keys, links, written = _keyed(edges)
    found, seen = materialize(links.withColumn("dist", F.lit(1)), "pairs", edge_rows=F.count(F.lit(1)))
    known, spent = [found], []
    reach, at_reach = 1, seen["edge_rows"]
    while at_reach and (max_depth is None or reach < max_depth):
        everything = union(known)
        head = known[-1].where(F.col("dist") == reach).select("node", F.col("anc").alias("mid"))
        tail = everything.select(F.col("node").alias("mid"), "anc", (F.col("dist") + reach).alias("dist"))
        if max_depth is not None:
            tail = tail.where(F.col("dist") <= max_depth)
        longer = head.join(tail, "mid").select("node", "anc", "dist")
        # One aggregate both removes repeats and finds what is new: a pair seen
        # before keeps a distance within the old reach.
        fresh = (
            everything.unionByName(longer)
            .groupBy("node", "anc")
            .agg(F.min("dist").alias("dist"))
            .where(F.col("dist") > reach)
        )
        reach *= 2
        found, seen = materialize(
            fresh,
            "pairs",
            rows=F.count(F.lit(1)),
            at_reach=F.count(F.when(F.col("dist") == reach, 1)),
        )
        (known if seen["rows"] else spent).append(found)
        at_reach = seen["at_reach"]
    discard(written, *spent)
    return Closure(keys, union(known))


def ancestor_pairs(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, anc, dist): every ancestor of every node and its distance."""
    return closure(edges, max_depth).named()


def _members(sets: list[DataFrame]) -> DataFrame:
    return union(sets).select("node", F.explode("members").alias("member"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, anc): the pairs of ``ancestor_pairs`` without distances.

    Dead ends are peeled off, the pairs of what stays are closed, and each peeled node's set of names is made once, from the
    finished sets of its sources.  A graph that does not peel is closed as a whole.
    """
    known = edges.where("source IS NOT NULL AND target IS NOT NULL")
    links, seen = materialize(known.select("source", "target").distinct(), "links", n=rows())
    peeled = peel(links, seen["n"])
    core = closure(peeled.core).named().select("node", "anc")
    if not peeled.layers:
        discard(links)
        return core
    core, _ = materialize(core, "pairs")
    parts = max(1, -(-seen["n"] // PART))
    known, _ = materialize(as_sets(core.select("node", F.col("anc").alias("member")), parts), "sets")
    discard(links)
    _, *peeled_sets = sets_down(peeled, known, parts, True)
    return core.unionByName(_members(peeled_sets).withColumnRenamed("member", "anc"))


def _per_node(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def nested_count(nodes: DataFrame, closed: Closure | Acyclic) -> DataFrame:
    """(id, n): distinct ancestors without the node itself, 0 where there are none."""
    return _per_node(nodes, closed.counts("node"))


def descendant_count(nodes: DataFrame, closed: Closure | Acyclic) -> DataFrame:
    """(id, n): distinct descendants without the node itself, 0 where there are none."""
    return _per_node(nodes, closed.counts("anc"))


def _steps(edges: DataFrame, up: bool, down: bool) -> DataFrame:
    """(dir, id, nxt): one row per allowed move along an edge."""
    src, dst = F.col("source"), F.col("target")
    moves = []
    if up:
        moves.append(F.struct(F.lit("up").alias("dir"), dst.alias("id"), src.alias("nxt")))
    if down:
        moves.append(F.struct(F.lit("down").alias("dir"), src.alias("id"), dst.alias("nxt")))
    return edges.select("source", "target").distinct().select(F.inline(F.array(*moves)))


def _spread(edges: DataFrame, start: DataFrame, up: bool, down: bool, hops: int) -> DataFrame:
    """``start`` and all that follows from its rows, with the first ``hop`` of each.

    Rows are told apart by every column of ``start`` but ``hop``.  ``hops`` moves are made per job: each move is one
    join and one distinct; then only the new candidates are looked up among the known rows.
    """
    keys = [c for c in start.columns if c != "hop"]
    steps, _ = materialize(_steps(edges, up, down), "steps")
    visited, seen = materialize(start, "reach", pending=F.count(F.lit(1)))
    known, frontier, depth, turn = [visited], visited, 0, 0
    pending = seen["pending"]
    while pending:
        moves, at = [], frontier.select(*keys)
        for k in range(1, hops + 1):
            at = at.join(steps, ["dir", "id"]).withColumn("id", F.col("nxt")).select(*keys).distinct()
            moves.append(at.withColumn("hop", F.lit(depth + k)))
        reached = union(moves).groupBy(*keys).agg(F.min("hop").alias("hop"))
        fresh = reached.join(union(known).select(*keys), keys, "left_anti")
        depth, turn = depth + hops, turn + 1
        frontier, seen = materialize(fresh, "reach", pending=F.count(F.when(F.col("hop") == depth, 1)))
        pending = seen["pending"]
        known = fold([*known, frontier], turn, "reach")
        frontier = known[-1].where(F.col("hop") == depth)
    discard(steps)
    return union(known)


def _seeded(seeds: DataFrame, up: bool, down: bool, per_seed: bool) -> DataFrame:
    dirs = [d for d, on in (("up", up), ("down", down)) if on]
    own = [F.col("id").alias("seed")] if per_seed else []
    ids = seeds.select("id").distinct().select(*own, "id")
    return ids.withColumn("dir", F.explode(F.array(*[F.lit(d) for d in dirs]))).withColumn("hop", F.lit(0))


def reachable(
    edges: DataFrame, seeds: DataFrame, up: bool = True, down: bool = True, hops: int = 4
) -> DataFrame:
    """(seed, id, dir, hop): nodes reachable from each seed, the seed itself at hop 0.

    The work follows the frontier of the seeds, never the whole closure; its rows are
    seeds times what each reaches, which is the result.
    """
    found = _spread(edges, _seeded(seeds, up, down, True), up, down, hops)
    return found.select("seed", "id", "dir", "hop")


def reached(
    edges: DataFrame, seeds: DataFrame, up: bool = True, down: bool = True, hops: int = 4
) -> DataFrame:
    """(id, dir, hop): nodes reachable from any seed; at most two rows per node, however many seeds."""
    return _spread(edges, _seeded(seeds, up, down, False), up, down, hops).select("id", "dir", "hop")


def lineage_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id): each seed with its ancestors and its descendants.

    Ancestors follow the seeds' frontier, descendants too within the core that stays when dead ends are peeled off; each
    peeled node takes the seeds of its sources as one set, so no row of a seed and a node is moved from hop to hop.
    """
    links, seen = materialize(edges.select("source", "target").distinct(), "links", n=rows())
    peeled = peel(links, seen["n"])
    wanted, given = materialize(seeds.select("id").distinct(), "seeds", n=rows())
    up = reachable(links, wanted, down=False).select("seed", "id")
    down, _ = materialize(reachable(peeled.core, wanted, up=False).select(F.col("id").alias("node"), F.col("seed").alias("member")), "pairs")
    below = down.select(F.col("member").alias("seed"), F.col("node").alias("id"))
    # A node that a seed reaches both ways is the seed itself or on a cycle, so it stands in the core's pairs.
    there = below.select(F.col("seed").alias("_seed"), F.col("id").alias("_id"))
    above = up.join(there, up["seed"].eqNullSafe(there["_seed"]) & up["id"].eqNullSafe(there["_id"]), "left_anti")
    both = above.unionByName(below)
    if not peeled.layers:
        return both
    parts = max(1, -(-given["n"] // PART))
    known, _ = materialize(as_sets(down, parts), "sets")
    _, *peeled_sets = sets_down(peeled, known, parts, False)
    return both.unionByName(_members(peeled_sets).select(F.col("member").alias("seed"), F.col("node").alias("id")))


def _passed(layers: list[DataFrame], start: list[DataFrame], ahead: str, behind: str) -> list[DataFrame]:
    """``start`` and, layer by layer, the ids on side ``ahead`` of links whose other side was met."""
    found = start
    for at in range(0, len(layers), TURNS):
        fresh = []
        for links in layers[at : at + TURNS]:
            there = union([*found, *fresh]).select(F.col("id").alias(behind))
            fresh.append(links.join(there, behind, "left_semi").select(F.col(ahead).alias("id")).distinct())
        found = [*found, materialize(union(fresh), "tree")[0]]
    return found


def _tree(edges: DataFrame, seeds: DataFrame, up: bool, down: bool) -> DataFrame:
    """(id): nodes reachable from any seed, each once.

    The frontier is followed within the core that stays when dead ends are peeled off.  Layers are passed once each way, from the
    outermost in on the way up and from the core out on the way down, so their links are joined once and not once a move.
    """
    links, seen = materialize(edges.select("source", "target").distinct(), "links", n=rows())
    peeled = peel(links, seen["n"])
    start = materialize(seeds.select("id").distinct(), "seeds")[0]
    above = _passed(peeled.layers, [start], "source", "target") if up else []
    begin = [(ids, way, side) for ids, way, side, on in ((above, "up", "target", up), ([start], "down", "source", down)) if on]
    entered = []
    for ids, way, side in begin:
        inside = peeled.core.select(F.col(side).alias("id")).distinct()
        entered.append(union(ids).distinct().join(inside, "id", "left_semi").select("id", F.lit(way).alias("dir"), F.lit(0).alias("hop")))
    core = _spread(peeled.core, union(entered), up, down, 4)
    below = _passed(peeled.layers[::-1], [start, core.where("dir = 'down'").select("id")], "target", "source") if down else []
    found = union([start, *above, core.select("id"), *below]).distinct()
    discard(links)
    peeled.discard()
    return found


def upstream_tree(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): the seeds and everything they are built from."""
    return _tree(edges, seeds, True, False)


def focus_tree(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): nodes to hide so that only the seeds' lineage stays."""
    return nodes.select("id").join(_tree(edges, seeds, True, True), "id", "left_anti")


def select_tree(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, selected) for every node."""
    chosen = _tree(edges, seeds, True, True).withColumn("hit", F.lit(True))
    return (
        nodes.select("id")
        .join(chosen, "id", "left")
        .select("id", F.col("hit").isNotNull().alias("selected"))
    )


def topo_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rank, cyclic): longest path from a source, over the graph with its cycles condensed.

    Nodes that reach each other share one rank and are ``cyclic``; every other node is ranked as if
    such a group were one node.  Nodes that no edge touches have rank 0.
    """
    keys, links, n = numbered(edges)
    peeled = peel(links, n)
    core, _ = materialize(peeled.core, "core")
    # ``condensed`` discards the core; without layers every node of an edge is in it.
    inside = keys
    if peeled.layers:
        ends = core.select(F.explode(F.array("source", "target")).alias("key")).distinct()
        inside, _ = materialize(keys.join(ends, "key", "left_semi").select("id", "key"), "keys")
    graph = condensed(inside, core)
    known, _ = materialize(graph.members.join(ranks(graph), "rep", "left").select(F.col("key").alias("node"), F.coalesce("rank", F.lit(0).cast("long")).alias("rank"), "cyclic"), "ranks")
    _, *outer = ranked_down(peeled, known.select("node", "rank"))
    found = union([known, *(x.withColumn("cyclic", F.lit(False)) for x in outer)])
    found = found.join(keys.withColumnRenamed("key", "node"), "node").select("id", "rank", "cyclic")
    discard(graph.links, links)
    peeled.discard()
    ranked = nodes.select("id").distinct().join(found, "id", "left")
    return ranked.select("id", F.coalesce("rank", F.lit(0)).cast("int").alias("rank"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))

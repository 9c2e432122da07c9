"""Cycles and chains taken out of a graph, so that what walks it afterwards has few and short rounds.

Links are ``(source, target, length)`` with 8-byte keys.  Every loop writes one table per round in the shared folder, and only
counts cross to the driver.  A chain is a walk of nodes with one link in and one out; its nodes learn both ends by pointer
jumping, so a chain or a plain cycle of n nodes takes about log2(n) rounds, not n.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.session import discard, materialize

#: Levels that one job trims, and hops that one job lets labels, marks and ranks spread.
TRIMMED, HOPS = 4, 4
#: Fewer inner nodes of chains than this are left where they are.
WORTH = 16
#: A row holds about this many members of a set at most.
PART = 1_000_000
#: Nodes that more links enter tell the codes apart before they gather them.
HUB = 64
#: Every so many rounds the tables of a loop are folded into one, so that deep graphs keep short plans.
FOLD = 8


def rows() -> Column:
    return F.count(F.lit(1))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def fold(frames: list[DataFrame], turn: int, label: str) -> list[DataFrame]:
    if turn % FOLD:
        return frames
    one, _ = materialize(union(frames), label)
    discard(*frames)
    return [one]


@dataclass(frozen=True)
class Contracted:
    """A graph without the inner nodes of its chains.

    ``links`` joins what is left; ``chains(node, first, before, last, after)`` has every inner node with the nodes that its
    chain comes from and leads to and its distance to both; ``rings(node, rep)`` are nodes of cycles that
    nothing else touches, with the smallest node of each; ``loops(node)`` are nodes whose chain led back to themselves.
    """

    links: DataFrame
    chains: DataFrame
    rings: DataFrame
    loops: DataFrame
    n_links: int

    def discard(self) -> None:
        discard(self.links, self.chains, self.rings, self.loops)


def longest(links: DataFrame) -> DataFrame:
    """Links without repeats; of parallel ones the longest."""
    return links.groupBy("source", "target").agg(F.max("length").alias("length"))


def contract(links: DataFrame) -> Contracted | None:
    """``links`` (distinct, without loops) with every chain replaced by one link of its length; None when fewer than ``WORTH`` nodes stand in chains."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.col("target").alias("after"), F.lit(None).cast("long").alias("before"), F.col("length").alias("out"), F.lit(None).cast("long").alias("into")),
        F.struct(F.col("target").alias("node"), F.lit(None).cast("long").alias("after"), F.col("source").alias("before"), F.lit(None).cast("long").alias("out"), F.col("length").alias("into")),
    )
    around = links.select(F.inline(ends)).groupBy("node").agg(
        F.count("after").alias("outs"), F.count("before").alias("ins"), F.max("after").alias("after"), F.max("before").alias("before"), F.max("out").alias("out"), F.max("into").alias("into")
    )
    around, seen = materialize(around.where("outs = 1 AND ins = 1"), "inner", n=rows())
    inner = seen["n"]
    if inner < WORTH:
        discard(around)
        return None
    ways = F.array(
        F.struct(F.lit(True).alias("ahead"), F.col("after").alias("at"), F.col("out").alias("far")),
        F.struct(F.lit(False).alias("ahead"), F.col("before").alias("at"), F.col("into").alias("far")),
    )
    within = around.select("node", F.inline(ways))
    jumps = within.select("node", "ahead", "at", "far", F.lit(True).alias("open"), F.least("node", "at").alias("low"))
    jumps, seen = materialize(jumps, "jumps", open=F.count_if("open"))
    covered = 1
    # After k rounds a pointer has passed 2^k nodes; what is open once that exceeds all inner nodes goes round a ring.
    while seen["open"] and covered <= 2 * inner:
        there = jumps.select(F.col("node").alias("at"), "ahead", F.col("at").alias("then"), F.col("far").alias("on"), F.col("open").alias("still"), F.col("low").alias("other"))
        before = jumps
        moved = before.where("open").join(there, ["at", "ahead"], "left").select(
            "node", "ahead", F.coalesce("then", "at").alias("at"), (F.col("far") + F.coalesce("on", F.lit(0))).alias("far"),
            F.coalesce("still", F.lit(False)).alias("open"), F.least("low", "other").alias("low"),
        )
        jumps, seen = materialize(before.where("NOT open").unionByName(moved), "jumps", open=F.count_if("open"))
        discard(before)
        covered *= 2
    rings, _ = materialize(jumps.where("open AND ahead").select("node", F.col("low").alias("rep")), "rings")
    side = lambda ahead, c: F.max(F.when(F.col("ahead") == F.lit(ahead), F.col(c)))
    chains = jumps.where("NOT open").groupBy("node").agg(
        side(False, "at").alias("first"), side(False, "far").alias("before"), side(True, "at").alias("last"), side(True, "far").alias("after")
    )
    chains, _ = materialize(chains, "chains")
    taken = around.select("node")
    rest = links.join(taken, links["source"] == taken["node"], "left_anti").join(taken, links["target"] == taken["node"], "left_anti")
    # The inner node next to a chain's first node stands for the chain.
    heads = chains.join(links.select(F.col("target").alias("node"), F.col("source").alias("first")), ["node", "first"], "left_semi")
    short = heads.select(F.col("first").alias("source"), F.col("last").alias("target"), (F.col("before") + F.col("after")).alias("length"))
    both, _ = materialize(longest(rest.select("source", "target", "length").unionByName(short)), "contracted")
    loops, _ = materialize(both.where("source = target").select(F.col("source").alias("node")), "loops")
    kept, seen = materialize(both.where("source != target"), "contracted", n=rows())
    discard(around, jumps, both)
    return Contracted(kept, chains, rings, loops, seen["n"])


def _trim(links: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Links left when, ``TRIMMED`` times over, those go whose source nothing enters or whose target nothing leaves."""
    left = links
    for _ in range(TRIMMED):
        entered = left.select(F.col("target").alias("source")).distinct()
        exited = left.select(F.col("source").alias("target")).distinct()
        left = left.join(entered, "source", "left_semi").join(exited, "target", "left_semi").select(*links.columns)
    kept, seen = materialize(left, label, n=rows())
    return kept, seen["n"]


def _colours(links: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that reaches each node, itself included."""
    nodes = links.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    colours, _ = materialize(nodes.select("node", F.col("node").alias("colour")), "colours")
    changed = 1
    while changed:
        offers, at = [], colours
        for _ in range(HOPS):
            at = links.join(at.select(F.col("node").alias("source"), "colour"), "source").groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("colour"))
            offers.append(at)
        best = union(offers).groupBy("node").agg(F.max("colour").alias("offer"))
        before = colours
        better = before.join(best, "node", "left").select("node", F.greatest("colour", "offer").alias("colour"), (F.col("offer") > F.col("colour")).alias("up"))
        colours, seen = materialize(better, "colours", up=F.count_if("up"))
        changed = seen["up"]
        discard(before)
    return colours


def _closed_back(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the roots and what reaches them along ``links``."""
    found, seen = materialize(roots.select("node"), "marked", n=rows())
    known, fresh, turn = [found], found, 0
    while seen["n"]:
        moves, at = [], fresh
        for _ in range(HOPS):
            at = links.join(at.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node")).distinct()
            moves.append(at)
        new = union(moves).distinct().join(union(known), "node", "left_anti")
        fresh, seen = materialize(new, "marked", n=rows())
        turn += 1
        known = fold([*known, fresh], turn, "marked")
        fresh = known[-1] if len(known) == 1 else fresh
    whole, _ = materialize(union(known), "marked")
    discard(*known)
    return whole


def strong_components(links: DataFrame) -> DataFrame:
    """(node, rep): every node on a cycle and one node of its component; ``links(source, target)`` by key.

    Chains are contracted and dead ends trimmed, several levels per job, until neither helps.  Then every node takes the
    greatest node that reaches it as its colour.  The nodes that a colour's own node can be reached from
    within the colour are its component, what is left keeps only links within a colour, and all of it is repeated.  No pairs of
    nodes are ever made.  Nodes that reach themselves by a single link count as cycles of one.
    """
    whole = links.select("source", "target").distinct()
    left, seen = materialize(whole.where("source != target").withColumn("length", F.lit(1).cast("long")), "core", n=rows())
    count, contracted, found, spent = seen["n"], [], [], []
    while count:
        before = None
        while count and count != before:
            before = count
            spent.append(left)
            left, count = _trim(left, "core")
            if count and (small := contract(left)):
                contracted.append(small)
                found.append(small.rings)
                spent.append(left)
                left, count = small.links, small.n_links
        spent.append(left)
        if not count:
            break
        colours = _colours(left)
        ends = left.join(colours.select(F.col("node").alias("source"), "colour"), "source")
        ends = ends.join(colours.select(F.col("node").alias("target"), F.col("colour").alias("other")), "target")
        inside, _ = materialize(ends.where("colour = other").select("source", "target", "length"), "coloured")
        marked = _closed_back(inside, colours.where("node = colour"))
        own = marked.join(colours, "node").select("node", F.col("colour").alias("rep"))
        # A colour of which nothing else reaches its own node starts no cycle.
        cyclic = own.groupBy("rep").agg(rows().alias("n")).where("n > 1").select("rep")
        members, _ = materialize(own.join(cyclic, "rep", "left_semi").select("node", "rep"), "component")
        found.append(members)
        rest = inside.join(marked, inside["source"] == marked["node"], "left_anti").join(marked, inside["target"] == marked["node"], "left_anti")
        left, seen = materialize(rest, "core", n=rows())
        count = seen["n"]
        spent += [colours, inside, marked, members]
    spent.append(left)
    # Nodes come back in the reverse of the order in which they went; one that is on a cycle by now keeps its component.
    alone = lambda nodes, known: nodes.join(known, "node", "left_anti").select("node", F.col("node").alias("rep"))
    selves = whole.where("source = target").select(F.col("source").alias("node"))
    grouped = union(found) if found else alone(selves, selves)
    for small in reversed(contracted):
        grouped, _ = materialize(grouped.unionByName(alone(small.loops, grouped)), "components")
        spent.append(grouped)
        first = grouped.select(F.col("node").alias("first"), "rep")
        last = grouped.select(F.col("node").alias("last"), F.col("rep").alias("other"))
        within = small.chains.join(first, "first").join(last, "last").where("rep = other")
        grouped = grouped.unionByName(within.select("node", "rep"))
    grouped, _ = materialize(grouped, "components")
    spent.append(grouped)
    grouped, _ = materialize(grouped.unionByName(alone(selves, grouped)), "components")
    for small in contracted:
        small.discard()
    discard(*spent)
    return grouped


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``keys(id, key)``, the distinct edges by key, and how many these are."""
    ends, _ = materialize(edges.select("source", "target").distinct(), "links")
    ids = ends.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    keys, _ = materialize(ids.select("id", F.monotonically_increasing_id().alias("key")), "keys")
    source = keys.select(F.col("id").alias("source"), F.col("key").alias("from"))
    target = keys.select(F.col("id").alias("target"), F.col("key").alias("to"))
    links = ends.join(source, "source").join(target, "target").select(F.col("from").alias("source"), F.col("to").alias("target"))
    links, seen = materialize(links, "links", n=rows())
    discard(ends)
    return keys, links, seen["n"]


@dataclass(frozen=True)
class Acyclic:
    """A graph with each cycle's component as one node.

    ``keys(id, key)`` names the nodes that an edge touches; ``members(key, rep, cyclic)`` has them all; ``links(source,
    target)`` joins different reps.  It answers what a ``Closure`` answers about counts and cycles, without pairs.
    """

    keys: DataFrame
    members: DataFrame
    links: DataFrame

    def counts(self, by: str) -> DataFrame:
        """(id, n): other nodes that reach each node (``by`` "node") or that it reaches ("anc")."""
        return reach_sizes(self, down=by == "anc").join(self.keys, "key").select("id", "n")

    def looped(self) -> DataFrame:
        """(id): nodes that reach themselves."""
        return self.members.where("cyclic").join(self.keys, "key").select("id")

    def discard_links(self) -> None:
        discard(self.links)


def acyclic(edges: DataFrame) -> Acyclic:
    """Number the nodes, find the strong components and link them."""
    return condensed(*numbered(edges)[:2])


def condensed(keys: DataFrame, links: DataFrame) -> Acyclic:
    """``acyclic`` of a graph whose nodes are numbered; ``links`` is a table of its own and discarded."""
    groups = strong_components(links)
    named = keys.select("key").join(groups.select(F.col("node").alias("key"), "rep"), "key", "left")
    members, _ = materialize(named.select("key", F.coalesce("rep", "key").alias("rep"), F.col("rep").isNotNull().alias("cyclic")), "members")
    joined = links
    for end in ("source", "target"):
        joined = joined.join(groups.select(F.col("node").alias(end), F.col("rep").alias("_rep")), end, "left")
        joined = joined.withColumn(end, F.coalesce("_rep", end)).drop("_rep")
    between, _ = materialize(joined.where("source != target").select("source", "target").distinct(), "links")
    discard(links, groups)
    return Acyclic(keys, members, between)


def _farthest(links: DataFrame) -> DataFrame:
    """(node, rank): the longest walk that ends at each node, over ``links(source, target, length)`` without cycles.

    Each round lets nodes whose rank has grown offer it to their targets, several hops per job.
    """
    nodes = links.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    known, seen = materialize(nodes.select("node", F.lit(0).cast("long").alias("rank"), F.lit(True).alias("up")), "rank", n=rows())
    while seen["n"]:
        offers, at = [], known.where("up").select("node", "rank")
        for _ in range(HOPS):
            at = links.join(at.select(F.col("node").alias("source"), "rank"), "source").groupBy(F.col("target").alias("node")).agg(F.max(F.col("rank") + F.col("length")).alias("rank"))
            offers.append(at)
        best = union(offers).groupBy("node").agg(F.max("rank").alias("offer"))
        before = known
        grown = before.join(best, "node", "left").select("node", F.greatest("rank", "offer").alias("rank"), F.coalesce(F.col("offer") > F.col("rank"), F.lit(False)).alias("up"))
        known, seen = materialize(grown, "rank", n=F.count_if("up"))
        discard(before)
    return known


def ranks(graph: Acyclic) -> DataFrame:
    """(rep, rank): links on the longest walk from a node that nothing enters; reps without links are left out.

    Chains are contracted first; inner nodes of chains follow from the node that their chain comes from.
    """
    weighted, _ = materialize(graph.links.withColumn("length", F.lit(1).cast("long")), "weighted")
    small = contract(weighted)
    known = _farthest(small.links if small else weighted)
    found = known.select(F.col("node").alias("rep"), "rank")
    if small:
        inner = small.chains.join(known.select(F.col("node").alias("first"), "rank"), "first")
        found = found.unionByName(inner.select(F.col("node").alias("rep"), (F.col("rank") + F.col("before")).alias("rank")))
    found, _ = materialize(found, "ranks")
    discard(weighted, known)
    if small:
        small.discard()
    return found


def _walk(links: DataFrame, nodes: DataFrame, weigh: Callable[[str], Column], spare: bool, harvest: Callable[[DataFrame], DataFrame], parts: int, hubs: bool) -> DataFrame:
    """(node, n): what ``harvest`` makes of every node's set, summed; level by level, each set is made once, from the finished sets of its sources.

    ``nodes(node, level, last, tail, own)`` has the codes a node adds to what it hands on and the greatest level it links to;
    ``links(source, target, level, last, tail, wide)`` has its target's.  Sets are rows ``(node, part, last, tail, n, codes)``:
    a part holds the codes of the nodes that hash to it, ``n`` is what ``weigh`` makes of those that came in, and with ``spare`` a
    node that hands on nothing has no codes.  When tables are folded, sets that no later level reads are dropped.
    """
    arrays = lambda c, here: (F.col(c) if here else F.lit(None).cast("array<bigint>")).alias(c)
    own = nodes.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
    first = own.where("level = 0").select("node", "part", "last", "tail", F.lit(0).cast("long").alias("n"), F.col("own").alias("codes"))
    first, _ = materialize(first, "sets")
    live, recent, sums = [first], [first], []
    total = lambda found: found.groupBy("node").agg(F.sum("n").alias("n"))
    last = links.agg(F.max("level")).first()[0] or 0
    for level in range(1, last + 1):
        there = union(live).where(F.col("last") >= level).select(F.col("node").alias("source"), "part", "codes")
        come = links.where(F.col("level") == level).join(there, "source").select(F.col("target").alias("node"), "part", "last", "tail", "codes", "wide")
        if hubs:
            # A node that many enter tells its codes apart before it gathers them.
            key = ["node", "part", "last", "tail"]
            apart = come.where("wide").select(*key, F.explode("codes").alias("code")).distinct().groupBy(*key).agg(F.collect_list("code").alias("codes"))
            come = come.where("NOT wide").drop("wide").unionByName(apart)
        mine = own.where(F.col("level") == level).select("node", "part", "last", "tail", arrays("codes", False), "own")
        both = come.select("node", "part", "last", "tail", "codes", arrays("own", False)).unionByName(mine)
        met = both.groupBy("node", "part").agg(
            F.max("last").alias("last"), F.max("tail").alias("tail"), F.array_distinct(F.flatten(F.collect_list("codes"))).alias("met"), F.flatten(F.collect_list("own")).alias("own")
        )
        codes = F.concat("own", "met")
        made = met.select("node", "part", "last", "tail", weigh("met").alias("n"), (F.when(F.col("last").isNotNull(), codes) if spare else codes).alias("codes"))
        fresh, _ = materialize(made, "sets")
        live.append(fresh)
        recent.append(fresh)
        if level % FOLD == 0 and level < last:
            done, _ = materialize(total(harvest(union(recent))), "reach")
            sums = fold([*sums, done], len(sums) + 1, "reach")
            still, _ = materialize(union(live).where(F.col("last") > level), "sets")
            discard(*live)
            live, recent = [still], []
    found, _ = materialize(total(union([harvest(union(recent)), *sums])), "reach")
    discard(*live, *sums)
    return found


def reach_sizes(graph: Acyclic, down: bool = False) -> DataFrame:
    """(key, n): how many other nodes reach each node (or, ``down``, are reached from it).

    Chains are contracted, and what reaches others through a single node only is no member of any set but a weight of that node:
    inner nodes of chains, and nodes that nothing enters and one link leaves.  Of the rest ``_walk`` makes each node's set of
    ancestors once; sizes are summed per set, or, ``down``, per member.  A member is a code: its number times 64, plus the power of two it
    weighs; one that weighs no power of two has a code for each bit.
    """
    sizes, _ = materialize(graph.members.groupBy("rep").agg(rows().alias("size")), "sizes")
    # A link is as long as its source has members, so distances along a chain count the nodes passed.
    weighted = graph.links.join(sizes.select(F.col("rep").alias("source"), F.col("size").alias("length")), "source").select("source", "target", "length")
    weighted, _ = materialize(weighted, "weighted")
    small = contract(weighted)
    short = (small.links if small else weighted).select("source", "target")
    outs = short.groupBy("source").agg(rows().alias("n"), F.max("target").alias("into")).where("n = 1")
    folded, _ = materialize(outs.join(short.select(F.col("target").alias("source")), "source", "left_anti").select(F.col("source").alias("rep"), "into"), "folded")
    kept, seen = materialize(short.join(folded.select(F.col("rep").alias("source")), "source", "left_anti").withColumn("length", F.lit(1).cast("long")), "links", n=rows())
    levels = _farthest(kept)

    def added(nodes: DataFrame, to: str) -> DataFrame:
        return nodes.join(sizes.select(F.col("rep").alias("of"), "size"), "of").groupBy(F.col(to).alias("rep")).agg(F.sum("size").alias("n"))

    light = [folded.select(F.col("rep").alias("of"), "into")]
    if small:
        light.append(small.chains.select(F.col("node").alias("of"), F.col("last").alias("into")))
    before, _ = materialize(added(union(light), "into"), "light")
    tails = added(small.chains.select(F.col("node").alias("of"), "first"), "first") if small else before.limit(0)
    tails, _ = materialize(tails, "light")
    level = levels.select("node", F.col("rank").alias("level"))
    ends = kept.join(level.select(F.col("node").alias("target"), "level"), "target").groupBy("source").agg(F.max("level").alias("last"))
    size = sizes.join(before.withColumnRenamed("n", "lighter"), "rep", "left").join(tails.withColumnRenamed("n", "longer"), "rep", "left")
    size = size.select("rep", "size", (F.col("size") + F.coalesce("lighter", F.lit(0))).alias("weight"), (F.col("size") + F.coalesce("longer", F.lit(0))).alias("tail"))
    size, _ = materialize(size, "sizes")
    code = F.call_function("shiftleft", F.col("node"), F.lit(6))
    if down:
        own, heavy = F.array(code), F.lit(False)
    else:
        set_bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.call_function("getbit", F.col("weight"), b) == 1)
        own, heavy = F.when(F.col("weight") == 1, F.array(code)).otherwise(F.transform(set_bits, lambda b: code + b)), F.col("weight") > 1
    nodes = level.join(ends, level["node"] == ends["source"], "left").drop("source").join(size.withColumnRenamed("rep", "node"), "node")
    hands_on = F.lit(True) if down else F.col("last").isNotNull()
    nodes = nodes.select("node", "level", "last", "tail", F.when(hands_on, own).otherwise(F.array().cast("array<bigint>")).alias("own"), (hands_on & heavy).alias("heavy"))
    nodes, known = materialize(nodes, "levels", n=rows(), heavy=F.count_if("heavy"))
    ins = kept.groupBy("target").agg((rows() > HUB).alias("wide"))
    into = ins.join(nodes.select(F.col("node").alias("target"), "level", "last", "tail"), "target")
    into, hubs = materialize(kept.select("source", "target").join(into, "target"), "links", n=F.count_if("wide"))

    def weigh(c: str) -> Column:
        if not known["heavy"]:
            return F.size(c).cast("long")
        return F.aggregate(c, F.lit(0).cast("long"), lambda sum_, x: sum_ + F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))

    def harvest(sets: DataFrame) -> DataFrame:
        if down:
            return sets.select(F.explode("codes").alias("code"), F.col("tail").alias("n")).select(F.shiftright("code", 6).alias("node"), "n")
        return sets.select("node", "n")

    found = _walk(into, nodes.drop("heavy"), weigh, not down, harvest, -(-max(known["n"], 1) // PART), bool(hubs["n"]))
    # With the nodes of its own cycle, each; first those that are no inner nodes of chains.
    plain = size.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    counted = plain.select("rep", "size", (F.coalesce("n", "size") if down else F.coalesce("n", F.lit(0)) + F.col("weight")).alias("n"))
    others = []
    if down:
        ahead = folded.join(counted.select(F.col("rep").alias("into"), "n"), "into").join(size.select("rep", "tail"), "rep")
        others.append(ahead.select("rep", (F.col("n") + F.col("tail")).alias("n")))
    if small and down:
        inner = small.chains.join(counted.select(F.col("rep").alias("last"), "n"), "last")
        others.append(inner.select(F.col("node").alias("rep"), (F.col("n") + F.col("after")).alias("n")))
    elif small:
        inner = small.chains.join(counted.select(F.col("rep").alias("first"), (F.col("n") - F.col("size")).alias("n")), "first").join(sizes.withColumnRenamed("rep", "node"), "node")
        others.append(inner.select(F.col("node").alias("rep"), (F.col("n") + F.col("before") + F.col("size")).alias("n")))
    counted = counted.select("rep", "n")
    if others:
        counted = counted.join(union(others).select("rep"), "rep", "left_anti").unionByName(union(others))
    counted, _ = materialize(counted, "reach")
    discard(sizes, weighted, folded, kept, levels, before, tails, size, nodes, into, found)
    if small:
        small.discard()
    return graph.members.select("key", "rep").join(counted, "rep").select("key", (F.col("n") - 1).alias("n"))

"""Strong components, chain contraction, ranks and reach bitmaps against brute force; rounds counted by their writes."""

import random

import pytest

from lineloom import session
from lineloom.operators import closure, condense

DEEP = 10_000


def _graphs():
    rng = random.Random(3)
    out = {"empty": [], "self": [(1, 1), (1, 2), (2, 2), (3, 4)]}
    out["ring"] = [(i, (i + 1) % 50) for i in range(50)]
    out["ring with a chord and tails"] = out["ring"] + [(10, 40), (60, 0), (0, 61)] + [(61 + i, 62 + i) for i in range(30)]
    out["chain"] = [(i, i + 1) for i in range(60)]
    # Two rings, joined by a long chain, one of them led back to by another.
    out["rings"] = [(i, (i + 1) % 20) for i in range(20)] + [(100 + i, 100 + (i + 1) % 20) for i in range(20)]
    out["rings"] += [(0, 200), *[(200 + i, 201 + i) for i in range(25)], (225, 100), (105, 300), *[(300 + i, 301 + i) for i in range(25)], (325, 105)]
    out["parallel chains"] = [(0, 10), *[(10 + i, 11 + i) for i in range(20)], (30, 99), (0, 40), *[(40 + i, 41 + i) for i in range(30)], (70, 99), (0, 99), (99, 0)]
    out["ladder"] = [(i, i + 1) for i in range(30)] + [(i, i + 2) for i in range(29)]
    for k in range(4):
        n = rng.randrange(20, 60)
        out[f"random {k}"] = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(n // 2, 2 * n))]
    return out


def _together(graphs):
    """One graph of many, side by side, so that every loop runs once for all of them."""
    return [(1000 * k + s, 1000 * k + t) for k, links in enumerate(graphs.values()) for s, t in links]


GRAPHS = _graphs()


def _reach(links):
    """node -> nodes that it reaches by one link or more."""
    after = {}
    for s, t in links:
        after.setdefault(s, set()).add(t)
    out = {}
    for start in {x for e in links for x in e}:
        seen, todo = set(), [start]
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out[start] = seen
    return out


def _keyed(spark, links):
    return spark.createDataFrame(links, "source long, target long")


def _named(spark, links):
    return spark.createDataFrame([(f"n{s}", f"n{t}") for s, t in links], "source string, target string")


@pytest.fixture
def writes(monkeypatch):
    labels = []
    real = condense.materialize

    def watched(df, label, **metrics):
        labels.append(label)
        return real(df, label, **metrics)

    monkeypatch.setattr(condense, "materialize", watched)
    return labels


def test_components_ranks_and_reach(spark, monkeypatch):
    # Small graphs must take the ways of large ones.
    monkeypatch.setattr(condense, "WORTH", 1)
    links = _together(GRAPHS)
    nodes = {x for e in links for x in e}
    ahead, behind = _reach(links), _reach([(t, s) for s, t in links])
    cyclic = {n for n in nodes if n in ahead[n]}
    group = {n: frozenset({n} | {m for m in ahead[n] if n in ahead[m]}) for n in nodes}
    got = {r["node"]: r["rep"] for r in condense.strong_components(_keyed(spark, links)).collect()}
    assert set(got) == cyclic
    for a in cyclic:
        assert {b for b in cyclic if got[b] == got[a]} == group[a] and got[a] in group[a]

    memo = {}

    def rank(g):
        if g not in memo:
            above = {group[s] for s, t in links if t in g} - {g}
            memo[g] = 1 + max(map(rank, above)) if above else 0
        return memo[g]

    ids = spark.createDataFrame([(f"n{n}",) for n in [*nodes, -1]], "id string")
    ranked = {r["id"]: (r["rank"], r["cyclic"]) for r in closure.topo_rank(ids, _named(spark, links)).collect()}
    assert ranked == {f"n{n}": (rank(group[n]), n in cyclic) for n in nodes} | {"n-1": (0, False)}
    graph = condense.acyclic(_named(spark, links))
    for by, reach in (("node", behind), ("anc", ahead)):
        counts = {r["id"]: r["n"] for r in graph.counts(by).collect()}
        assert counts == {f"n{n}": len(reach[n] - {n}) for n in nodes}
    assert {r["id"] for r in graph.looped().collect()} == {f"n{n}" for n in cyclic}


def test_empty_graph(spark):
    assert condense.strong_components(_keyed(spark, [])).count() == 0
    graph = condense.acyclic(_named(spark, []))
    assert graph.counts("node").count() == graph.looped().count() == condense.ranks(graph).count() == 0


def test_bitmaps_equal_pairs(spark):
    rng = random.Random(9)
    links = [(rng.randrange(i), i) for i in range(1, 400) for _ in range(2)] + [(30, 3), (7, 7)]
    edges = _named(spark, links)
    pairs, bitmaps = closure.closure(edges), condense.acyclic(edges)
    for by in ("node", "anc"):
        want = {r["id"]: r["n"] for r in pairs.counts(by).collect()}
        assert {r["id"]: r["n"] for r in bitmaps.counts(by).collect() if r["n"]} == want
    assert {r["id"] for r in pairs.looped().collect()} == {r["id"] for r in bitmaps.looped().collect()}


def test_jobs_grow_with_the_logarithm_of_a_chain(spark, writes):
    chain = spark.range(DEEP).selectExpr("concat('n', id) source", "concat('n', id + 1) target")
    nodes = spark.range(DEEP + 1).selectExpr("concat('n', id) id")
    ranked = closure.topo_rank(nodes, chain)
    assert ranked.where("concat('n', rank) != id OR cyclic").count() == 0 and ranked.count() == DEEP + 1
    assert len(writes) <= 60 and writes.count("jumps") <= 2 * 16 and writes.count("core") <= 4
    writes.clear()
    counted = condense.acyclic(chain).counts("node")
    assert counted.where("concat('n', n) != id").count() == 0 and counted.count() == DEEP + 1
    assert writes.count("bitmaps") <= 3


@pytest.mark.parametrize("n, extra", [(100_000, []), (DEEP, [(5, 3_000)])])
def test_a_long_cycle_takes_few_jobs(spark, writes, n, extra):
    ring = spark.range(n).selectExpr("id source", f"(id + 1) % {n} target")
    if extra:
        ring = ring.unionByName(_keyed(spark, extra))
    found = condense.strong_components(ring)
    assert found.count() == n and found.select("rep").distinct().count() == 1
    assert len(writes) <= 40, writes


def test_loops_leave_only_what_results_read(spark):
    session.clear_scratch(spark)
    found = condense.strong_components(_keyed(spark, GRAPHS["rings"]))
    where = spark._jvm.org.apache.hadoop.fs.Path(session.scratch_root(spark))
    left = [s.getPath().getName().split("-")[0] for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    assert left == ["components"] and found.count() == 66


def test_each_set_is_written_once(spark, monkeypatch):
    # Two tables read by each, one reader of its own each, in small parts, gathered as for hubs.
    monkeypatch.setattr(condense, "PART", 7)
    monkeypatch.setattr(condense, "HUB", 1)
    links = [(k // d, k) for k in range(2, 60) for d in (2, 3)] + [(1000 + k, k) for k in range(60)] + [(500, 501), (501, 500), (500, 5)]
    tables, made = condense.materialize, []

    def stored(df, label, **metrics):
        out, seen = tables(df, label, **metrics)
        if label == "sets":
            made.extend(r["node"] for r in out.select("node").distinct().collect())
        return out, seen

    monkeypatch.setattr(condense, "materialize", stored)
    monkeypatch.setattr(condense, "FOLD", 1000)
    graph = condense.acyclic(_named(spark, links))
    behind = _reach([(t, s) for s, t in links])
    assert {r["id"]: r["n"] for r in graph.counts("node").collect()} == {f"n{n}": len(found - {n}) for n, found in behind.items()}
    assert made and len(made) == len(set(made)) <= 61
    ahead = _reach(links)
    assert {r["id"]: r["n"] for r in graph.counts("anc").collect()} == {f"n{n}": len(found - {n}) for n, found in ahead.items()}

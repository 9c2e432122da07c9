"""Transitive operators against brute force on small random graphs."""

import random

import pytest

from lineloom.operators import audit, closure


def _distances(links, start):
    """Shortest positive-length walk from ``start`` following target -> source."""
    out, frontier, d = {}, {start}, 0
    while frontier:
        d += 1
        frontier = {s for n in frontier for (s, t) in links if t == n} - set(out)
        out.update({n: d for n in frontier})
    return out


def _graphs():
    rng = random.Random(7)
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("r0", "out"), ("in", "r3")]
    mixed = [(f"v{rng.randrange(30)}", f"v{rng.randrange(30)}") for _ in range(45)]
    mixed = [(a, b) for a, b in mixed if a != b]
    return {"chain": chain, "ring": ring, "mixed": mixed + mixed[:5], "empty": []}


def test_loops_leave_only_what_their_results_read(spark):
    from lineloom import session
    from lineloom.sources import tables

    links = GRAPHS["mixed"]
    _, nodes = _nodes(spark, links)
    session.clear_scratch(spark)
    ranks = closure.topo_rank(nodes, _edges(spark, links))
    where = spark._jvm.org.apache.hadoop.fs.Path(session.scratch_root(spark))
    left = {s.getPath().getName().split("-")[0] for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)}
    assert "links" not in left and ranks.count() == nodes.count()
    assert tables.path_exists(spark, session.scratch_root(spark))


GRAPHS = _graphs()


def _edges(spark, links):
    rows = [(f"{s}-{t}", s, t, "resolved") for s, t in links]
    return spark.createDataFrame(rows, "edge_id string, source string, target string, kind string")


def _nodes(spark, links):
    ids = {x for e in links for x in e} | {"lonely"}
    return ids, spark.createDataFrame([(i,) for i in sorted(ids)], "id string")


@pytest.mark.parametrize("name", GRAPHS)
def test_pairs_and_counts(spark, name):
    links = GRAPHS[name]
    ids, nodes = _nodes(spark, links)
    want = {(n, a, d) for n in ids for a, d in _distances(links, n).items()}
    closed = closure.closure(_edges(spark, links))
    got = [tuple(r) for r in closed.named().collect()]
    assert len(got) == len(set(got)) and set(got) == want

    up = {r["id"]: r["n"] for r in closure.nested_count(nodes, closed).collect()}
    assert up == {n: sum(1 for (m, a, _) in want if m == n and a != n) for n in ids}
    down = {r["id"]: r["n"] for r in audit.audit_impact(nodes, closed).collect()}
    assert down == {n: sum(1 for (m, a, _) in want if a == n and m != n) for n in ids}
    assert {r["id"] for r in audit.audit_cycles(closed).collect()} == {n for (n, a, _) in want if n == a}


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_max_depth(spark, depth):
    links = GRAPHS["mixed"]
    ids, _ = _nodes(spark, links)
    want = {(n, a, d) for n in ids for a, d in _distances(links, n).items() if d <= depth}
    got = {tuple(r) for r in closure.ancestor_pairs(_edges(spark, links), max_depth=depth).collect()}
    assert got == want


@pytest.mark.parametrize("hops", [1, 3])
@pytest.mark.parametrize("name", ["chain", "ring", "mixed"])
def test_lineage_from_seeds(spark, name, hops):
    links = GRAPHS[name]
    ids, nodes = _nodes(spark, links)
    seeds = sorted(ids)[:3]
    back = [(t, s) for s, t in links]
    up = {s: set(_distances(links, s)) | {s} for s in seeds}
    down = {s: set(_distances(back, s)) | {s} for s in seeds}
    sdf = spark.createDataFrame([(s,) for s in seeds], "id string")
    edges = _edges(spark, links)
    got = {(r["seed"], r["id"], r["dir"]) for r in closure.reachable(edges, sdf, hops=hops).collect()}
    assert got == {(s, n, "up") for s in seeds for n in up[s]} | {(s, n, "down") for s in seeds for n in down[s]}
    if hops == 3:
        whole = set().union(*up.values(), *down.values())
        assert {r["id"] for r in closure.upstream_tree(edges, sdf).collect()} == set().union(*up.values())
        assert {r["id"] for r in closure.focus_tree(nodes, edges, sdf).collect()} == ids - whole
        chosen = {r["id"]: r["selected"] for r in closure.select_tree(nodes, edges, sdf).collect()}
        assert chosen == {n: n in whole for n in ids}


@pytest.mark.parametrize("name", GRAPHS)
def test_topo_rank(spark, name):
    links = GRAPHS[name]
    ids, nodes = _nodes(spark, links)
    walks = {n: set(_distances(links, n)) for n in ids}
    group = {n: frozenset(m for m in ids if m in walks[n] and n in walks[m]) | {n} for n in ids}

    def rank(g):
        above = {group[s] for s, t in links if group[t] == g} - {g}
        return 1 + max(map(rank, above)) if above else 0

    got = {r["id"]: (r["rank"], r["cyclic"]) for r in closure.topo_rank(nodes, _edges(spark, links)).collect()}
    assert got == {n: (rank(group[n]), n in walks[n]) for n in ids}


def test_hub_holding_a_third_of_all_edges(spark):
    links = [("hub", f"a{i}") for i in range(300)] + [(f"b{i}", "hub") for i in range(300)]
    links += [(f"a{i}", f"c{i}") for i in range(300)]
    _, nodes = _nodes(spark, links)
    got = {r["id"]: r["n"] for r in closure.nested_count(nodes, closure.closure(_edges(spark, links))).collect()}
    assert got["hub"] == 300 and got["a7"] == 301 and got["c7"] == 302 and got["lonely"] == 0


@pytest.mark.parametrize("name", [*GRAPHS, "fan"])
def test_peeled_layers_give_what_the_whole_graph_gives(spark, monkeypatch, name):
    from lineloom.operators import condense, layers

    # Small graphs must take the ways of large ones; ``fan`` peels to a core with a cycle, has roots, hubs and parts.
    monkeypatch.setattr(layers, "CORE", 4)
    monkeypatch.setattr(layers, "HUB", 3)
    monkeypatch.setattr(closure, "PART", 40)
    fan = [(f"n{k // d}", f"n{k}") for k in range(2, 90) for d in (2, 3)] + [("n7", "n3"), ("n3", "n3"), ("lake", "n40"), ("lake", "n80")]
    links = sorted(set(fan + [(f"n{k}", "n88") for k in range(30, 60)])) + [("n2", "n4")] if name == "fan" else GRAPHS[name]
    ids, nodes = _nodes(spark, links)
    edges = _edges(spark, links)
    peeled, written = [], []
    peel, store = closure.peel, layers.materialize
    monkeypatch.setattr(closure, "peel", lambda *a: peeled.append(peel(*a)) or peeled[-1])
    monkeypatch.setattr(layers, "materialize", lambda df, label, **m: written.append(label) or store(df, label, **m))

    walks = {n: set(_distances(links, n)) for n in ids}
    got = [tuple(r) for r in closure.ancestors(edges).collect()]
    assert sorted(got) == sorted((n, a) for n in ids for a in walks[n])

    back = [(t, s) for s, t in links]
    seeds = sorted(ids)[:7] + ["nowhere"]
    got = [tuple(r) for r in closure.lineage_of(edges, spark.createDataFrame([(s,) for s in seeds * 2], "id string")).collect()]
    want = {(s, n) for s in seeds for n in set(_distances(links, s)) | set(_distances(back, s)) | {s}}
    assert sorted(got) == sorted(want)

    group = {n: frozenset(m for m in ids if m in walks[n] and n in walks[m]) | {n} for n in ids}
    memo = {}

    def rank(g):
        if g not in memo:
            above = {group[s] for s, t in links if t in g} - {g}
            memo[g] = 1 + max(map(rank, above)) if above else 0
        return memo[g]

    got = {r["id"]: (r["rank"], r["cyclic"]) for r in closure.topo_rank(nodes, edges).collect()}
    assert got == {n: (rank(group[n]), n in walks[n]) for n in ids}
    if name == "fan":
        assert all(len(p.layers) >= 4 for p in peeled) and {"rank", "sets", "wide"} <= set(written)


@pytest.mark.parametrize("name", [*GRAPHS, "fan"])
def test_trees_walk_the_core_only(spark, monkeypatch, name):
    from lineloom.operators import layers

    monkeypatch.setattr(layers, "CORE", 4)
    fan = [(f"n{k // d}", f"n{k}") for k in range(2, 90) for d in (2, 3)] + [("n7", "n3"), ("n3", "n3"), ("lake", "n40"), ("lake", "n80")]
    links = sorted(set(fan)) if name == "fan" else GRAPHS[name]
    ids, nodes = _nodes(spark, links)
    edges = _edges(spark, links)
    steps, store = [], closure.materialize

    def counted(df, label, **metrics):
        stored, seen = store(df, label, **metrics)
        if label == "steps":
            steps.append(stored.count())
        return stored, seen

    monkeypatch.setattr(closure, "materialize", counted)
    back = [(t, s) for s, t in links]
    for some in (sorted(ids)[:3], sorted(ids)[-3:] + ["nowhere"], []):
        seeds = spark.createDataFrame([(s,) for s in some * 2], "id string")
        up = {n for s in some for n in _distances(links, s)} | set(some)
        both = up | {n for s in some for n in _distances(back, s)}
        assert sorted(r["id"] for r in closure.upstream_tree(edges, seeds).collect()) == sorted(up)
        assert sorted(r["id"] for r in closure.focus_tree(nodes, edges, seeds).collect()) == sorted(set(ids) - both)
        assert {r["id"]: r["selected"] for r in closure.select_tree(nodes, edges, seeds).collect()} == {n: n in both for n in ids}
    if name == "fan":
        assert max(steps) < len(links) // 4, steps

"""Golden graph of a small layered project, name resolution, views and audits."""

import pytest

from lineloom.operators import audit, closure, folders, graph, stubs, views
from lineloom.operators.parse import last_definition_wins, parse_scripts
from lineloom.plans import lineage as lin

# A small project of our own: path, text.
PROJECT = [
    ("farm/bronze/fields.sql", "CREATE OR REPLACE TABLE agro.land.fields AS SELECT 1 FROM survey.plots"),
    ("farm/bronze/rain.sql", "CREATE TABLE land.rain (day DATE, mm INT) PARTITION BY DATE(day);"),
    ("farm/silver/wet_fields.sql", "CREATE VIEW agro.crops.wet AS SELECT f.id FROM agro.land.fields f JOIN land.rain r ON true # from nowhere"),
    ("farm/silver/seeds.sql", "CREATE TABLE crops.seeds AS WITH picked AS (SELECT 1 FROM `store.bags`) SELECT 1 FROM picked"),
    ("farm/gold/harvest.sql", "CREATE OR REPLACE TABLE yield.harvest AS SELECT 1 FROM agro.crops.wet, UNNEST(rows) AS x JOIN crops.seeds s ON true"),
    ("farm/gold/report.sql", "CREATE OR REPLACE VIEW `yield.report` AS SELECT 1 FROM yield.harvest -- from lies"),
    ("farm/notes/idle.sql", "SELECT 1 FROM `a.b.missing`"),
]

# id: label, layer, type, project, dataset, direct off, nested off, direct on, nested on
GOLDEN = {
    "fields": ("fields", "bronze", "table", "agro", "land", 0, 0, 1, 1),
    "rain": ("rain", "bronze", "table", "default", "default", 0, 0, 0, 0),
    "wet_fields": ("wet", "silver", "view", "agro", "crops", 2, 2, 2, 3),
    "seeds": ("seeds", "silver", "table", "default", "crops", 0, 0, 2, 2),
    "harvest": ("harvest", "gold", "table", "default", "yield", 2, 4, 2, 7),
    "report": ("report", "gold", "view", "default", "yield", 1, 5, 1, 8),
    "idle": ("idle", "other", "table", "default", "notes", 0, 0, 1, 1),
}


def _scripts(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


@pytest.mark.parametrize("discovery", [False, True])
def test_golden_graph(spark, discovery):
    nodes, edges = lin.full_graph(_scripts(spark, PROJECT), discovery=discovery)
    rows = {r["id"]: r for r in nodes.collect()}
    assert len(rows) == (11 if discovery else 7)
    assert edges.count() == (9 if discovery else 5)
    for key, want in GOLDEN.items():
        r = rows[key]
        got = (r["label"], r["layer"], r["type"], r["project"], r["dataset"])
        assert got == want[:5], key
        counts = want[7:] if discovery else want[5:7]
        assert (r["direct_count"], r["nested_count"]) == counts, key
    if discovery:
        ghosts = {k for k, r in rows.items() if r["layer"] == "external"}
        assert ghosts == {"survey.plots", "store.bags", "a.b.missing"}
        assert {k for k, r in rows.items() if r["layer"] == "cte"} == {"cte:seeds:picked"}


def test_node_details(spark):
    records = last_definition_wins(parse_scripts(_scripts(spark, PROJECT)))
    nodes, _ = graph.discovery_graph(records, lin.resolved_deps(records), True)
    got = {r["id"]: r for r in graph.node_details(nodes, records).collect()}
    assert len(got) == 11 and got["rain"]["content"] == PROJECT[1][1]
    assert got["seeds"]["ctes"] == {"picked": "SELECT 1 FROM `store.bags`"}
    assert got["cte:seeds:picked"]["content"] == "SELECT 1 FROM `store.bags`"
    assert got["survey.plots"]["content"] == "-- Discovered dependency" and got["survey.plots"]["dependencies"] == []


def test_layer_choice(spark):
    rows = [("x_gold/landing/a.sql", "SELECT 1"), ("x_gold/misc/b.sql", "SELECT 1"), ("x_gold/mart/silver/c.sql", "SELECT 1")]
    layers = lambda **o: {r["id"]: r["layer"] for r in lin.lineage(_scripts(spark, rows), **o).nodes.collect()}
    assert layers() == {"a": "gold", "b": "gold", "c": "silver"}
    assert layers(root="x_gold") == {"a": "other", "b": "other", "c": "silver"}
    assert layers(root="x_gold", aliases=True) == {"a": "bronze", "b": "other", "c": "silver"}


def test_folder_selection_limits_the_graph(spark):
    nodes, edges = lin.full_graph(_scripts(spark, PROJECT), folders=["farm/silver"])
    assert {r["id"] for r in nodes.collect()} == {"wet_fields", "seeds"}
    assert edges.count() == 0
    assert lin.full_graph(_scripts(spark, PROJECT), folders=[])[0].count() == 0


def test_lookup_prefers_exact_then_last_part(spark):
    rows = [
        ("w/gold/a.sql", "CREATE TABLE d1.t AS SELECT 1"),
        ("w/gold/b.sql", "CREATE TABLE d2.t AS SELECT 1"),
        ("w/gold/c.sql", "SELECT 1 FROM d1.t, p.d2.t, zz.t, t, nowhere"),
    ]
    parsed = last_definition_wins(parse_scripts(_scripts(spark, rows)))
    resolved = {r["dep"]: r["node_id"] for r in lin.resolved_deps(parsed).collect()}
    # The bare name belongs to the record with the greatest path.
    assert resolved == {"d1.t": "a", "p.d2.t": "b", "zz.t": "b", "t": "b", "nowhere": None}


def test_repeated_spellings_count_twice_and_self_edges_are_dropped(spark):
    rows = [
        ("w/gold/users.sql", "CREATE TABLE ds.users AS SELECT 1"),
        ("w/gold/x.sql", "SELECT 1 FROM users JOIN ds.users ON true"),
        ("w/gold/y.sql", "CREATE TABLE ds.z AS SELECT 1 FROM other.y"),
    ]
    g = lin.lineage(_scripts(spark, rows))
    assert [r["edge_id"] for r in g.edges.collect()] == ["users-x", "users-x"]
    assert {r["id"]: r["n"] for r in graph.direct_count(g.nodes, g.edges).collect()} == {"users": 0, "x": 2, "y": 0}


def test_a_third_of_all_scripts_share_a_name_and_a_source(spark):
    rows = [(f"p{i:04}/init.sql", "SELECT 1 FROM hot.dim") for i in range(300)]
    rows += [(f"w/q{i}.sql", f"SELECT 1 FROM hot.dim JOIN q{i + 1} ON true") for i in range(600)]
    g = lin.lineage(_scripts(spark, rows), discovery=True)
    parsed = {r["id"]: r["path"] for r in g.parsed.collect()}
    assert len(parsed) == 601 and parsed["init"] == "p0299/init.sql"
    counts = {r["id"]: r["n"] for r in graph.direct_count(g.nodes, g.edges).collect()}
    assert counts["init"] == 1 and counts["q5"] == 2 and counts["hot.dim"] == 0
    assert g.edges.where("source = 'hot.dim'").count() == 601


def test_views(spark):
    nodes = spark.createDataFrame(
        [("a", "Alpha", "gold", "table"), ("b", "beta", None, "view"), ("c", "alphabet", "external", "table"), ("d", "x", "cte", "cte")],
        "id string, label string, layer string, type string",
    )
    edges = spark.createDataFrame([("a-b", "a", "b", "k"), ("b-b", "b", "b", "k"), ("c-d", "c", "d", "k")], "edge_id string, source string, target string, kind string")
    hidden = spark.createDataFrame([("a",), ("a",)], "id string")
    got = {r["id"]: r["hidden"] for r in views.visible_nodes(nodes, ["gold", "other", "cte"], hidden).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}
    assert {r["edge_id"]: r["role"] for r in views.edge_role(edges, "b").collect()} == {"a-b": "incoming", "b-b": "incoming", "c-d": "other"}
    assert {r["id"] for r in views.node_search(nodes, "ALPHA").collect()} == {"a", "c"}
    assert [tuple(r) for r in views.node_groups(nodes).collect()] == [("cte", "d", "x", 1), ("external", "c", "alphabet", 1), ("standard", "a", "Alpha", 2), ("standard", "b", "beta", 2)]
    assert {r["id"] for r in views.source_nodes(nodes, edges).collect()} == {"a", "c"}
    before = spark.createDataFrame([("a", 3.0, 4.0), ("gone", 1.0, 1.0)], "id string, x double, y double")
    assert {r["id"]: (r["x"], r["y"]) for r in views.carry_positions(nodes, before).collect()}["a"] == (3.0, 4.0)


def test_layer_jumps(spark):
    nodes = spark.createDataFrame([("b", "bronze"), ("s", "silver"), ("g", "gold"), ("o", "other")], "id string, layer string")
    edges = spark.createDataFrame([("b", "s"), ("b", "g"), ("g", "s"), ("s", "s2"), ("o", "g"), ("b", "g")], "source string, target string")
    got = {(r["source"], r["target"], r["step"]) for r in audit.audit_layer_jumps(nodes, edges).collect()}
    assert got == {("b", "g", 2), ("g", "s", -1)}
    matrix = {(r["source_layer"], r["target_layer"]): r["n"] for r in audit.audit_layer_matrix(nodes, edges).collect()}
    assert matrix == {("bronze", "silver"): 1, ("bronze", "gold"): 2, ("gold", "silver"): 1, ("other", "gold"): 1}


def test_folders(spark):
    rows = [("a/b/c/x.sql", ""), ("a/bb/y.sql", ""), (".git/h.sql", ""), ("a/.tmp/z.sql", ""), ("top.sql", "")]
    scripts = _scripts(spark, rows)
    listed = folders.folder_list(scripts)
    assert [r["folder"] for r in listed.collect()] == ["a", "a/b", "a/b/c", "a/bb"]
    picked = spark.createDataFrame([("a/b",)], "folder string")
    below = folders.folder_subtree_expand(listed, picked)
    assert {r["folder"] for r in below.collect()} == {"a/b", "a/b/c"}
    paths = lambda f: {r["path"] for r in folders.folder_filter(scripts, f).collect()}
    assert paths(None) == {r[0] for r in rows}
    assert paths([]) == set()
    assert paths([""]) == {"top.sql"}
    assert paths(["a/b"]) == set()
    assert paths(below) == {"a/b/c/x.sql"}


def test_stubs(spark):
    ghosts = spark.createDataFrame([("p.d.t",), ("d.t",), ("t",)], "id string")
    got = {r["path"]: r["content"] for r in stubs.ghost_stub_sql(ghosts).collect()}
    assert set(got) == {"p/d.sql", "d/t.sql", "t.sql"}
    assert "CREATE OR REPLACE TABLE `d.t` AS\n" in got["d/t.sql"]
    wanted = spark.createDataFrame([("d/t.sql",), ("../x.sql",), ("t.sql",)], "path string")
    status = stubs.stub_admit(wanted, spark.createDataFrame([("t.sql",)], "path string"))
    assert {r["path"]: r["status"] for r in status.collect()} == {"d/t.sql": "ok", "../x.sql": "invalid path", "t.sql": "exists"}


def test_lineage_actions(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source string, target string")
    nodes = spark.createDataFrame([(i,) for i in "abcxy"], "id string")
    seeds = spark.createDataFrame([("b",)], "id string")
    act = lambda a: {r["id"] for r in lin.lineage_action(edges, nodes, seeds, a).collect()}
    assert act("hide") == {"b"}
    assert act("hideTree") == {"a", "b"}
    assert act("onlyTree") == {"x", "y"}
    assert act("selectTree") == set("abcxy")
    with pytest.raises(ValueError):
        act("explode")
    assert closure.lineage_of(edges, seeds).count() == 3

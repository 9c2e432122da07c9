"""Every operator as a query over the given tables: ``name -> f(spark, folder)``.

The given tables hold no SQL text, so the script corpus is derived from
``part``: one script per row, hence work grows with the table.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.operators import audit, closure, condense, folders, graph, parse, stubs, views
from lineloom.operators.medallion import bronze, gold, silver
from lineloom.plans import lineage as lin
from lineloom.plans import mart
from lineloom.plans.refresh import refresh
from lineloom.session import materialize, scratch_path
from lineloom.sources import snapshots, tables
from lineloom.sources.cases import CASES, case_scripts
from lineloom.sources.corpus import corpus
from lineloom.sources.scripts import export_scripts, relative_path, script_scan

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _scripts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(tables.table(spark, sf, "part"), "p_partkey")


def _all_records(spark, sf, columns=parse.LIGHT) -> DataFrame:
    """One record per file, copies included."""
    return parse.parse_scripts(_scripts(spark, sf), columns=columns)


def _records(spark, sf, columns=parse.LIGHT) -> DataFrame:
    """One record per id."""
    return lin.records(_scripts(spark, sf), columns=columns)


def _stored(spark, sf) -> DataFrame:
    return lin.stored_records(_scripts(spark, sf))


def _resolved(spark, sf) -> DataFrame:
    return lin.resolved_deps(_stored(spark, sf))


def _edges(spark, sf) -> DataFrame:
    return graph.edge_resolve(_resolved(spark, sf))


def _graph(spark, sf, discovery: bool = False) -> lin.Lineage:
    return lin.lineage(_scripts(spark, sf), discovery=discovery)


def _stored_graph(spark, sf, discovery: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, edges written once because loops read them often."""
    g = _graph(spark, sf, discovery)
    edges, _ = materialize(g.edges, "edges")
    return g.nodes, edges


def _seeds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds of the tree queries, many at once: nodes with at least three incoming edges."""
    return graph.direct_count(nodes, edges).where("n >= 3").select("id")


def _picked(spark, sf) -> DataFrame:
    """Seeds that keep their own rows: a table of fixed size, one script per nation."""
    key = F.col("n_nationkey").cast("string")
    return tables.table(spark, sf, "nation").select(F.concat(F.lit("t"), key).alias("id"))


# --- A. scripts to records ---------------------------------------------------


def _scan(spark, sf):
    """The corpus written as files and read back; hidden and empty scripts among them."""
    root = scratch_path(spark, "scripts")
    export_scripts(_odd_places(_scripts(spark, sf)), root)
    found = script_scan(spark, root)
    return found.select(relative_path(F.col("path"), root).alias("path"), "content")


def _odd_places(scripts: DataFrame) -> DataFrame:
    """A few scripts in places that file listings tend to leave out, and a few empty ones."""
    # Copies share their name with another script and stay where they are.
    key = F.when(~F.col("path").contains("/zz_copy/"), F.regexp_extract("path", r"t(\d+)\.sql$", 1).cast("long"))
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return scripts.select(
        F.when(key % 251 == 1, F.concat(F.lit("wh/_models/"), name))
        .when(key % 251 == 2, F.concat(F.lit("wh/_"), name))
        .when(key % 251 == 3, F.concat(F.lit("wh/.cache/deep/"), name))
        .otherwise(F.col("path"))
        .alias("path"),
        F.when(key % 251 == 4, "").otherwise(F.col("content")).alias("content"),
    )


QUERIES["script_scan"] = _scan


@query
def folder_list(spark, sf):
    return folders.folder_list(_scripts(spark, sf))


@query
def folder_filter(spark, sf):
    return folders.folder_filter(_scripts(spark, sf), ["wh/gold", "wh/zz_copy"]).select("path")


@query
def folder_subtree_expand(spark, sf):
    """Folders come from the parts' attributes: ``lake/<type>/<brand>/<size>``."""
    part = tables.table(spark, sf, "part")
    path = F.concat_ws(
        "/",
        F.lit("lake"),
        F.col("p_type"),
        F.col("p_brand"),
        F.col("p_size").cast("string"),
        F.concat(F.lit("t"), F.col("p_partkey").cast("string"), F.lit(".sql")),
    )
    listed = folders.folder_list(part.select(path.alias("path")))
    # A brand whose name starts another brand's name must not select it.
    picked = part.select(F.concat_ws("/", F.lit("lake"), F.col("p_type"), F.lit("Brand#1")).alias("folder"))
    return folders.folder_subtree_expand(listed, picked)


@query
def layer_classify(spark, sf):
    return folders.layer_classify(_scripts(spark, sf))


@query
def layer_alias_classify(spark, sf):
    names = ["raw", "Landing", "staging", "intermediate", "conformed", "mart", "serving", "presentation", "misc"]
    part = tables.table(spark, sf, "part")
    folder = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p_size") % len(names) + 1)
    outer = F.when(F.col("p_partkey") % 5 == 0, "gold").otherwise("wh")
    name = F.concat(F.lit("t"), F.col("p_partkey").cast("string"), F.lit(".sql"))
    scripts = part.select(F.concat_ws("/", outer, folder, name).alias("path"))
    return folders.layer_alias_classify(scripts, folders.alias_table(spark))


@query
def statement_kind(spark, sf):
    return parse.statement_kind(_all_records(spark, sf))


@query
def target_name(spark, sf):
    return parse.target_name(_all_records(spark, sf))


@query
def cte_extract(spark, sf):
    return parse.cte_extract(_all_records(spark, sf, parse.TEXTLESS))


@query
def table_refs(spark, sf):
    return parse.table_refs(_all_records(spark, sf))


@query
def parse_quarantine(spark, sf):
    """Both halves; together they are all records."""
    halves = parse.parse_quarantine(_all_records(spark, sf, parse.TEXTLESS))
    good, bad = (h.withColumn("good", F.lit(g)) for h, g in zip(halves, (True, False)))
    both = good.unionByName(bad)
    return both.select("id", "label", "layer", "type", "project", "dataset", "path", F.size("dependencies").alias("n_deps"), "error", "good")


@query
def script_cases(spark, sf):
    """One of many kinds of script per part, each in its dialect: what is read, or why not."""
    read = []
    for dialect in sorted({c.dialect for c in CASES}):
        scripts = case_scripts(tables.table(spark, sf, "part"), "p_partkey", dialect)
        read.append(parse.parse_scripts(scripts, dialect))
    every = functools.reduce(DataFrame.unionByName, read)
    return every.select("path", "type", "label", F.array_join("dependencies", " ").alias("refs"), F.coalesce("error", F.lit("")).alias("error"))


@query
def last_definition_wins(spark, sf):
    return _records(spark, sf).select(*graph.NODE)


@query
def parse_summary(spark, sf):
    return parse.parse_summary(_records(spark, sf, parse.TEXTLESS))


# --- B. graph ----------------------------------------------------------------


@query
def name_lookup(spark, sf):
    return graph.name_lookup(_records(spark, sf))


@query
def edge_resolve(spark, sf):
    return _edges(spark, sf)


@query
def ghost_nodes(spark, sf):
    return graph.ghost_nodes(_resolved(spark, sf))


@query
def ghost_edges(spark, sf):
    return graph.ghost_edges(_resolved(spark, sf))


@query
def cte_nodes(spark, sf):
    records, _ = materialize(_records(spark, sf, parse.TEXTLESS), "records")
    nodes = graph.cte_nodes(parse.table_refs(records))
    return nodes.join(graph.cte_contents(records), "id")


@query
def cte_edges(spark, sf):
    return graph.cte_edges(parse.table_refs(_records(spark, sf)))


@query
def discovery_graph(spark, sf):
    g = _graph(spark, sf, discovery=True)
    nodes = g.nodes.select(F.lit("node").alias("part"), "id", F.col("layer").alias("what"))
    edges = g.edges.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id"), F.col("kind").alias("what"))
    return nodes.unionByName(edges)


@query
def direct_count(spark, sf):
    g = _graph(spark, sf, discovery=True)
    return graph.direct_count(g.nodes, g.edges)


@query
def ancestor_pairs(spark, sf):
    return closure.ancestors(_edges(spark, sf))


@query
def nested_count(spark, sf):
    nodes, edges = _stored_graph(spark, sf)
    return closure.nested_count(nodes, condense.acyclic(edges))


@query
def node_table(spark, sf):
    return lin.full_graph(_scripts(spark, sf), discovery=True)[0]


@query
def node_details(spark, sf):
    records, _ = materialize(_records(spark, sf, parse.RECORD), "records")
    deps = parse.table_refs(records)
    resolved = graph.resolve(deps, graph.name_lookup(records))
    nodes, _ = graph.discovery_graph(records, resolved, True)
    details = graph.node_details(nodes, records)
    return details.select(
        "id", "content", F.array_join("dependencies", " ").alias("deps"), F.size(F.map_keys("ctes")).alias("n_ctes"), "error"
    )


@query
def layer_options(spark, sf):
    """Layers below a root whose own name holds a mark, by marks and by aliases."""
    scripts = _scripts(spark, sf).withColumn("path", F.concat(F.lit("gold_root/staging/"), F.col("path")))
    by = lambda **o: parse.parse_scripts(scripts, columns=("path", "layer"), **o)
    marks = by(root="gold_root/staging")
    aliases = by(root="gold_root", aliases=True).withColumnRenamed("layer", "alias_layer")
    return marks.join(aliases, "path")


@query
def lineage_of(spark, sf):
    _, edges = _stored_graph(spark, sf)
    return closure.lineage_of(edges, _picked(spark, sf))


@query
def upstream_tree(spark, sf):
    nodes, edges = _stored_graph(spark, sf)
    return closure.upstream_tree(edges, _seeds(nodes, edges))


@query
def focus_tree(spark, sf):
    nodes, edges = _stored_graph(spark, sf)
    return closure.focus_tree(nodes, edges, _seeds(nodes, edges))


@query
def select_tree(spark, sf):
    nodes, edges = _stored_graph(spark, sf)
    return closure.select_tree(nodes, edges, _seeds(nodes, edges))


@query
def visible_nodes(spark, sf):
    nodes = _stored(spark, sf).select(*graph.NODE)
    return views.visible_nodes(nodes, ["bronze", "gold", "other"], nodes.where("type = 'view'"))


@query
def edge_role(spark, sf):
    return views.edge_role(_edges(spark, sf), "t3")


@query
def node_search(spark, sf):
    return views.node_search(_records(spark, sf), "T1").select("id", "label")


@query
def node_groups(spark, sf):
    return views.node_groups(_graph(spark, sf, discovery=True).nodes)


@query
def source_nodes(spark, sf):
    g = _graph(spark, sf)
    return views.source_nodes(g.nodes, g.edges)


@query
def topo_rank(spark, sf):
    nodes, edges = _stored_graph(spark, sf)
    return closure.topo_rank(nodes, edges)


@query
def topo_rank_acyclic(spark, sf):
    """The same graph without the one planted edge that closes a cycle."""
    nodes, edges = _stored_graph(spark, sf)
    return closure.topo_rank(nodes, edges.where("NOT (source = 't7' AND target = 't3')"))


@query
def carry_positions(spark, sf):
    before = tables.table(spark, sf, "part").select(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_size").cast("double").alias("x"),
        F.col("p_retailprice").alias("y"),
    )
    nodes = _graph(spark, sf, discovery=True).nodes
    return views.carry_positions(nodes.select("id", "layer"), before)


def _saved(spark, sf, fmt):
    base = scratch_path(spark, "snapshots")
    g = _graph(spark, sf, discovery=True)
    snapshots.snapshot_save(base, g.nodes, g.edges, {"discovery": True, "dialect": "bigquery"}, "main", fmt)
    return base


@query
def snapshot_save(spark, sf):
    """Saved, loaded, changed and saved again under the same name."""
    base = _saved(spark, sf, "parquet")
    schema = "edge_id string, source string, target string, kind string"
    node_schema = ", ".join(f"{c} string" for c in graph.NODE)
    load = lambda part, s: snapshots.snapshot_load(spark, base, part, s, "main")
    kept = load("edges", schema).where("kind <> 'cte'")
    snapshots.snapshot_save(base, load("nodes", node_schema).where("layer <> 'cte'"), kept, {}, "main")
    return load("edges", schema)


@query
def snapshot_load(spark, sf):
    """The saved nodes, plus a snapshot that was never saved and so adds nothing."""
    base = _saved(spark, sf, "json")
    schema = ", ".join(f"{c} string" for c in graph.NODE)
    loaded = snapshots.snapshot_load(spark, base, "nodes", schema, "main", "json")
    return loaded.unionByName(snapshots.snapshot_load(spark, base, "nodes", schema, "absent", "json"))


def _earlier(scripts: DataFrame) -> DataFrame:
    """The corpus before its last changes: about one script in a hundred read something else, some were not
    there yet, and some that are gone now were."""
    key = F.regexp_extract("path", r"t(\d+)\.sql$", 1).cast("long")
    text = F.concat(F.lit("CREATE TABLE was.old"), key.cast("string"), F.lit(" AS SELECT * FROM t2 JOIN t"), (key + 1).cast("string"), F.lit(" USING (id)"))
    there = scripts.where(key % 150 != 57).select("path", F.when(key % 100 == 7, text).otherwise(F.col("content")).alias("content"))
    gone = scripts.where(key % 200 == 33).select(F.concat(F.lit("wh/zz_gone/"), F.regexp_extract("path", r"[^/]+$", 0)).alias("path"), text.alias("content"))
    return there.unionByName(gone)


@query
def graph_refresh(spark, sf):
    """The graph of an earlier corpus, stored, then brought up to date with the corpus as it is."""
    place, scripts = scratch_path(spark, "graph"), _scripts(spark, sf)
    refresh(_earlier(scripts), place)
    return refresh(scripts, place).nodes


@query
def ghost_stub_sql(spark, sf):
    return stubs.ghost_stub_sql(graph.ghost_nodes(_resolved(spark, sf)))


@query
def stub_admit(spark, sf):
    """Stubs of the missing tables, of tables that have a script, and of paths going upwards."""
    scripts = _scripts(spark, sf).select("path")
    wanted = stubs.ghost_stub_sql(graph.ghost_nodes(_resolved(spark, sf))).select("path")
    upward = scripts.select(F.concat(F.lit("../"), F.col("path")).alias("path"))
    return stubs.stub_admit(wanted.unionByName(scripts).unionByName(upward), scripts)


# --- C. audits ---------------------------------------------------------------


@query
def audit_orphans(spark, sf):
    g = _graph(spark, sf)
    return audit.audit_orphans(g.nodes, g.edges)


@query
def audit_cycles(spark, sf):
    return audit.audit_cycles(condense.acyclic(_edges(spark, sf)))


@query
def audit_impact(spark, sf):
    nodes, edges = _stored_graph(spark, sf)
    return audit.audit_impact(nodes, condense.acyclic(edges))


@query
def audit_layer_jumps(spark, sf):
    g = _graph(spark, sf)
    return audit.audit_layer_jumps(g.nodes, g.edges)


@query
def audit_layer_matrix(spark, sf):
    g = _graph(spark, sf, discovery=True)
    return audit.audit_layer_matrix(g.nodes, g.edges)


# --- D. medallion ------------------------------------------------------------


def _t(spark, sf, name):
    return tables.table(spark, sf, name)


def _user_sessions(spark, sf):
    events = _t(spark, sf, "events")
    session = F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return silver.sessions(events.select("user_id", session.alias("session_id"), "ts"))


def _cleaned(spark, sf):
    return mart.cleaned(_t(spark, sf, "orders"), _t(spark, sf, "customer"))


@query
def bronze_ingest(spark, sf):
    columns = {"id": "c_custkey", "name": "c_name", "segment": "c_mktsegment", "balance": "c_acctbal"}
    return bronze.ingest(_t(spark, sf, "customer"), columns)


@query
def bronze_typed_load(spark, sf):
    declared = {
        "log_id": ("event_id", "string"),
        "user_id": ("user_id", "string"),
        "log_time": ("ts", "timestamp_ntz"),
        "log_date": ("ts", "date"),
        "amount": ("value", "double"),
        "props": ("props", "json"),
    }
    loaded = bronze.typed_load(_t(spark, sf, "events"), declared)
    return loaded.withColumn("props", F.variant_get("props", "$.k", "int"))


@query
def bronze_rescued_load(spark, sf):
    """Event types stand among the numbers and broken JSON among the properties; both halves, with what did not fit."""
    key = F.col("event_id")
    raw = _t(spark, sf, "events").select(
        "event_id", F.when(key % 7 == 0, F.col("event_type")).otherwise(key.cast("string")).alias("code"),
        F.when(key % 11 == 0, F.concat(F.lit("{"), F.col("event_type"))).otherwise(F.col("props")).alias("props"),
    )
    loaded = bronze.typed_load(raw, {"log_id": ("event_id", "int"), "code": ("code", "long"), "doc": ("props", "json")}, rescued="rescued")
    good, bad = bronze.quarantine(loaded, "rescued")
    both = good.withColumn("rescued", F.lit(None).cast("map<string,string>")).unionByName(bad)
    lost = lambda name: F.try_element_at("rescued", F.lit(name)).alias(f"lost_{name}")
    return both.select("log_id", "code", F.variant_get("doc", "$.k", "int").alias("k"), lost("code"), lost("doc"))


@query
def bronze_partitioned_write(spark, sf):
    """A table of days of which the odd ones are written again, twice over."""
    logs, path = bronze.with_day(_t(spark, sf, "events"), "ts"), scratch_path(spark, "web-logs")
    tables.write_partitioned(logs.where("event_type <> 'click' OR day(ts) % 2 = 0"), path, "day")
    for _ in range(2):
        stored = tables.replace_partitions(logs.where("day(ts) % 2 = 1"), path, "day")
    return stored.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query
def select_all(spark, sf):
    return _t(spark, sf, "nation").select("*")


@query
def silver_clean(spark, sf):
    cleaned = silver.clean(_t(spark, sf, "orders"), "o_orderkey", "o_orderpriority", "o_orderdate")
    return tables.create_view(cleaned, f"orders_cleaned_{uuid.uuid4().hex}")


@query
def silver_orders_cleaned(spark, sf):
    return _cleaned(spark, sf)


@query
def silver_region_case(spark, sf):
    region = silver.region_of(F.col("c_nationkey"), mart.HOME, mart.EUROPE)
    return _t(spark, sf, "customer").select("c_custkey", "c_nationkey", region.alias("region"))


@query
def silver_sessions(spark, sf):
    return _user_sessions(spark, sf)


@query
def gold_user_stats(spark, sf):
    orders = _t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("order_day"), "o_orderkey")
    return gold.user_stats(orders, "order_day", "o_orderkey")


@query
def gold_daily_revenue(spark, sf):
    return gold.daily_revenue(_cleaned(spark, sf), mart.COMPLETED)


@query
def gold_monthly_revenue(spark, sf):
    """Amounts have a part below a cent, which the sum keeps."""
    orders = _t(spark, sf, "orders").select("o_orderdate", (F.col("o_totalprice") + 0.125).alias("amount"))
    return gold.monthly_revenue(orders, "o_orderdate", "amount")


@query
def gold_product_performance(spark, sf):
    """Each order line is packed as a JSON array of two shipments of its quantity."""
    item = lambda q: F.struct(
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("product_id"),
        q.cast("decimal(18,3)").cast("string").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
    )
    odd = F.when(F.col("l_linenumber") == 7, F.lit("many")).otherwise((F.col("l_quantity") - 1.125).cast("decimal(18,3)").cast("string"))
    second = item(F.lit(0)).withField("quantity", odd)
    packed = F.to_json(F.array(item(F.lit(1.125)), second))
    lines = _t(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return gold.product_performance(lines.select(packed.alias("items")))


@query
def gold_conversion_funnel(spark, sf):
    events = _t(spark, sf, "events").where("event_type = 'purchase'")
    placed = events.select("user_id", F.col("event_id").alias("order_id"), F.col("ts").alias("order_timestamp"))
    browsing = _t(spark, sf, "events").where("event_type <> 'purchase'")
    session = F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    visits = silver.sessions(browsing.select("user_id", session.alias("session_id"), "ts"))
    return gold.conversion_funnel(visits, placed)


@query
def gold_campaign_ctr(spark, sf):
    campaigns = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("campaign_id"))
    shown = _t(spark, sf, "customer").select(
        F.col("c_nationkey").alias("campaign_id"), F.col("c_custkey").alias("impression_id")
    )
    clicked = _t(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("campaign_id"), F.col("s_suppkey").alias("click_id")
    )
    return gold.campaign_ctr(campaigns, shown, clicked)


@query
def ops_delayed(spark, sf):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    return gold.delayed(_t(spark, sf, "lineitem"), "l_returnflag", "R", columns)


@query
def create_or_replace(spark, sf):
    """A table is created, then replaced by a part of itself; both versions are returned."""
    customer = _t(spark, sf, "customer")
    path = scratch_path(spark, "table")
    first = tables.create_table(customer.where("c_acctbal < 5000"), path)
    tables.create_table(tables.read_table(spark, path).where("c_acctbal < 0"), path, replace=True)
    second = tables.read_table(spark, path)
    return first.withColumn("version", F.lit(1)).unionByName(second.withColumn("version", F.lit(2)))


@query
def medallion_mart(spark, sf):
    return mart.medallion_mart(_t(spark, sf, "orders"), _t(spark, sf, "customer"))

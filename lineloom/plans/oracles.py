"""Independent SQL for each query, over the given tables.

For the script corpus the expected rows follow from arithmetic on the keys; no
oracle reads the scripts' text except the ones that return that text.
"""

from __future__ import annotations

from lineloom.sources.cases import case_oracle

# One row per file (copies included), with what its record must be.
_FILES = """
g AS (SELECT p_partkey AS k, p_partkey // 2 AS a, p_partkey // 3 AS b FROM part),
n AS (
  SELECT k, a, b, concat('t', k) AS nm,
    CASE k % 4 WHEN 0 THEN 'Bronze' WHEN 1 THEN 'silver' WHEN 2 THEN 'gold' ELSE 'misc' END AS folder
  FROM g),
files AS (
  SELECT *, FALSE AS is_copy, concat('wh/', folder, '/', nm, '.sql') AS path FROM n
  UNION ALL
  SELECT *, TRUE, concat('wh/zz_copy/', nm, '.sql') FROM n WHERE k % 101 = 0),
rec AS (
  SELECT k, a, b, nm AS id, nm AS label, path, is_copy,
    CASE WHEN is_copy THEN 'other' WHEN folder = 'misc' THEN 'other' ELSE lower(folder) END AS layer,
    CASE WHEN is_copy THEN 'table' WHEN k % 97 = 0 THEN 'unknown' WHEN k % 13 = 0 THEN 'table'
         WHEN k % 3 = 0 THEN 'view' ELSE 'table' END AS type,
    CASE WHEN k % 97 = 0 AND NOT is_copy THEN 'n/a' ELSE 'default' END AS project,
    CASE WHEN is_copy THEN 'zz_copy' WHEN k % 97 = 0 THEN 'n/a'
         WHEN k % 13 = 0 THEN CASE WHEN folder = 'misc' THEN 'misc' ELSE 'default' END
         ELSE concat('ds', k % 7) END AS dataset,
    NOT is_copy AND k % 97 <> 0 AS active
  FROM files),
win AS (SELECT * FROM rec WHERE is_copy OR k % 101 <> 0)
"""


def _refs(of: str) -> str:
    """Expected references; ``node`` is the key of the record a name resolves to."""
    return f"""
refs AS (
  SELECT id, concat('ds', a % 7, '.t', a) AS dep, a AS node, 'table' AS kind FROM {of} WHERE active AND a <> k
  UNION ALL SELECT id, concat('t', b), b, 'table' FROM {of} WHERE active AND b <> k
  UNION ALL SELECT id, concat('t', a), a, 'table' FROM {of} WHERE active AND k % 41 = 0 AND a <> k AND a <> b
  UNION ALL SELECT id, 't7', 7, 'table' FROM {of} WHERE active AND k = 3
  UNION ALL SELECT id, concat('ext.e', k % 50), NULL, 'table' FROM {of} WHERE active
  UNION ALL SELECT id, concat('cte:', id, ':c1'), NULL, 'cte' FROM {of} WHERE active)
"""


_EDGES = """
edges AS (
  SELECT concat('t', node, '-', id) AS edge_id, concat('t', node) AS source, id AS target,
    'resolved' AS kind FROM refs WHERE node IS NOT NULL),
all_edges AS (
  SELECT edge_id, source, target, kind FROM edges
  UNION ALL
  SELECT concat(dep, '-', id), dep, id, CASE WHEN kind = 'cte' THEN 'cte' ELSE 'external' END
  FROM refs WHERE node IS NULL),
ghosts AS (SELECT DISTINCT dep AS id FROM refs WHERE node IS NULL AND kind = 'table'),
ctes AS (SELECT dep AS id FROM refs WHERE kind = 'cte'),
nodes AS (
  SELECT id, label, layer, type, project, dataset, path FROM win),
all_nodes AS (
  SELECT * FROM nodes
  UNION ALL
  SELECT id, split_part(id, '.', 2), 'external', 'table', 'default', split_part(id, '.', 1), 'discovered'
  FROM ghosts
  UNION ALL
  SELECT id, split_part(id, ':', 3), 'cte', 'cte', 'internal', 'cte', 'internal' FROM ctes)
"""

# Transitive closure over a relation of edges.
_PAIRS = """
{name}(node, anc) AS (
  SELECT target, source FROM {edges}
  UNION
  SELECT p.node, e.source FROM {name} p JOIN {edges} e ON e.target = p.anc)
"""


def _q(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(c.strip() for c in ctes) + "\n" + select


def _files(select: str) -> str:
    return _q(select, _FILES)


def _file_refs(select: str) -> str:
    return _q(select, _FILES, _refs("rec"))


def _graph(select: str, *more: str) -> str:
    return _q(select, _FILES, _refs("win"), _EDGES, *more)


def _closed(select: str, *more: str, edges: str = "edges") -> str:
    pairs = _PAIRS.format(name="pairs", edges=edges)
    return _q(select, _FILES, _refs("win"), _EDGES, pairs, *more, recursive=True)


_PICKED = "seeds AS (SELECT concat('t', n_nationkey) AS id FROM nation)"
_SEEDS = "seeds AS (SELECT target AS id FROM edges GROUP BY target HAVING count(*) >= 3)"
_LINEAGE = """
lin AS (
  SELECT id AS seed, id FROM seeds
  UNION SELECT s.id, p.anc FROM seeds s JOIN pairs p ON p.node = s.id
  UNION SELECT s.id, p.node FROM seeds s JOIN pairs p ON p.anc = s.id)
"""

_SCRIPT_TEXT = """
body AS (
  SELECT *, concat('WITH c1 AS (SELECT * FROM ext.e', k % 50, ') SELECT a.id, ', chr(39), 'from fake_lit', chr(39),
    ' AS lit, EXTRACT(DAY FROM a.ts) AS d FROM ds', a % 7, '.t', a, ' a LEFT JOIN t', b,
    ' b ON a.id = b.id JOIN c1 ON a.id = c1.id',
    CASE WHEN k % 41 = 0 THEN concat(' JOIN t', a, ' dup ON dup.id = a.id') ELSE '' END,
    CASE WHEN k % 53 = 0 THEN concat(' JOIN ', id, ' self ON self.id = a.id') ELSE '' END,
    CASE WHEN k = 3 THEN ' JOIN t7 cyc ON cyc.id = a.id' ELSE '' END,
    CASE WHEN k % 19 = 0 THEN ', UNNEST(a.items) u' ELSE '' END,
    ' WHERE a.k IN (1, 2)') AS sel FROM rec)
"""

_SUBTREE = """
lists AS (
  SELECT DISTINCT p_type, p_brand, p_size FROM part),
fold AS (
  SELECT 'lake' AS folder FROM lists
  UNION SELECT concat('lake/', p_type) FROM lists
  UNION SELECT concat('lake/', p_type, '/', p_brand) FROM lists
  UNION SELECT concat('lake/', p_type, '/', p_brand, '/', p_size) FROM lists),
picked AS (SELECT DISTINCT concat('lake/', p_type, '/Brand#1') AS folder FROM part)
"""

_CLEANED = """
cleaned AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS user_id,
    o_orderdate AS order_timestamp, o_totalprice AS total_amount, o_orderstatus AS status,
    c_nationkey AS country
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus <> 'F')
"""

ORACLES = {
    # --- A
    "script_scan": _q(
        """SELECT CASE CASE WHEN is_copy THEN 0 ELSE k % 251 END
             WHEN 1 THEN concat('wh/_models/', id, '.sql') WHEN 2 THEN concat('wh/_', id, '.sql') WHEN 3 THEN concat('wh/.cache/deep/', id, '.sql') ELSE path END AS path, CASE
             WHEN k % 251 = 4 AND NOT is_copy THEN ''
             WHEN is_copy THEN concat('CREATE TABLE dup.', id, ' (id INT)')
             WHEN k % 97 = 0 THEN concat('CREATE OR REPLACE VIEW ds', k % 7, '.', id, ' AS (SELECT FROM')
             WHEN k % 13 = 0 THEN sel
             ELSE concat('-- from not_a_table', chr(10), 'CREATE OR REPLACE ',
                         CASE WHEN k % 3 = 0 THEN 'VIEW' ELSE 'TABLE' END, ' ds', k % 7, '.', id, ' AS ', sel)
           END AS content FROM body""",
        _FILES,
        _SCRIPT_TEXT,
    ),
    "folder_list": _files(
        """SELECT 'wh' AS folder FROM files
           UNION SELECT concat('wh/', CASE WHEN is_copy THEN 'zz_copy' ELSE folder END) FROM files"""
    ),
    "folder_filter": _files("SELECT path FROM files WHERE is_copy OR folder = 'gold'"),
    "folder_subtree_expand": _q(
        """SELECT DISTINCT f.folder FROM fold f JOIN picked p
           ON f.folder = p.folder OR starts_with(f.folder, concat(p.folder, '/'))""",
        _SUBTREE,
    ),
    "layer_classify": _files("SELECT path, layer FROM rec"),
    "layer_alias_classify": """
        SELECT concat(CASE WHEN p_partkey % 5 = 0 THEN 'gold' ELSE 'wh' END, '/', f, '/t', p_partkey, '.sql') AS path,
          CASE WHEN f IN ('raw', 'Landing', 'staging') THEN 'bronze'
               WHEN f IN ('intermediate', 'conformed') THEN 'silver'
               WHEN f IN ('mart', 'serving', 'presentation') OR p_partkey % 5 = 0 THEN 'gold'
               ELSE 'other' END AS layer
        FROM (SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'raw' WHEN 1 THEN 'Landing' WHEN 2 THEN 'staging'
                WHEN 3 THEN 'intermediate' WHEN 4 THEN 'conformed' WHEN 5 THEN 'mart' WHEN 6 THEN 'serving'
                WHEN 7 THEN 'presentation' ELSE 'misc' END AS f FROM part)""",
    "statement_kind": _files("SELECT id, path, type FROM rec"),
    "target_name": _files("SELECT id, path, project, dataset, label FROM rec"),
    "cte_extract": _files(
        "SELECT id, 'c1' AS cte, concat('SELECT * FROM ext.e', k % 50) AS body FROM rec WHERE active"
    ),
    "table_refs": _file_refs("SELECT id, dep, kind FROM refs"),
    "parse_quarantine": _file_refs(
        """SELECT id, label, layer, type, project, dataset, path, CAST(coalesce(d.n, 0) AS INTEGER) AS n_deps,
             CASE WHEN type = 'unknown' THEN 'unbalanced parentheses' END AS error, type <> 'unknown' AS good
           FROM rec LEFT JOIN (SELECT id AS ref_id, count(*) AS n FROM refs GROUP BY id) d
             ON d.ref_id = rec.id AND rec.active""",
    ),
    "script_cases": case_oracle(),
    "last_definition_wins": _files(
        """SELECT id, label, layer, type, project, dataset, path FROM rec
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY path DESC) = 1"""
    ),
    "parse_summary": _graph(
        """SELECT layer, type, count(*) AS scripts, count(*) FILTER (type = 'unknown') AS failures,
             CAST(sum(coalesce(d.n, 0)) AS BIGINT) AS dependencies
           FROM win LEFT JOIN (SELECT id, count(*) AS n FROM refs GROUP BY id) d USING (id)
           GROUP BY layer, type"""
    ),
    # --- B
    "name_lookup": _files(
        """SELECT name, arg_max(id, path) AS node_id FROM (
             SELECT id, path, id AS name FROM win
             UNION ALL SELECT id, path, concat(dataset, '.', label) FROM win WHERE dataset <> 'default'
             UNION ALL SELECT id, path, concat(project, '.', dataset, '.', label) FROM win
               WHERE dataset <> 'default' AND project <> 'default')
           GROUP BY name"""
    ),
    "edge_resolve": _graph("SELECT edge_id, source, target, kind FROM edges"),
    "ghost_nodes": _graph("SELECT * FROM all_nodes WHERE layer = 'external'"),
    "ghost_edges": _graph("SELECT * FROM all_edges WHERE kind = 'external'"),
    "cte_nodes": _graph(
        """SELECT n.*, concat('SELECT * FROM ext.e', k % 50) AS content
           FROM all_nodes n JOIN win w ON n.id = concat('cte:', w.id, ':c1') WHERE n.layer = 'cte'"""
    ),
    "cte_edges": _graph("SELECT * FROM all_edges WHERE kind = 'cte'"),
    "discovery_graph": _graph(
        """SELECT 'node' AS part, id, layer AS what FROM all_nodes
           UNION ALL SELECT 'edge', edge_id, kind FROM all_edges"""
    ),
    "direct_count": _graph(
        """SELECT n.id, count(e.target) AS n FROM all_nodes n LEFT JOIN all_edges e ON e.target = n.id
           GROUP BY n.id"""
    ),
    "ancestor_pairs": _closed("SELECT node, anc FROM pairs"),
    "nested_count": _closed(
        """SELECT n.id, count(p.anc) AS n FROM nodes n
           LEFT JOIN pairs p ON p.node = n.id AND p.anc <> n.id GROUP BY n.id"""
    ),
    "node_table": _closed(
        """SELECT n.*, CAST(coalesce(d.n, 0) AS INTEGER) AS direct_count, coalesce(a.n, 0) AS nested_count
           FROM all_nodes n
           LEFT JOIN (SELECT target AS id, count(*) AS n FROM all_edges GROUP BY target) d USING (id)
           LEFT JOIN (SELECT node AS id, count(*) AS n FROM pairs WHERE node <> anc GROUP BY node) a USING (id)""",
        edges="all_edges",
    ),
    "node_details": _q(
        """SELECT n.id, CASE n.layer WHEN 'external' THEN '-- Discovered dependency'
             WHEN 'cte' THEN concat('SELECT * FROM ext.e', o.k % 50)
             ELSE CASE WHEN w.is_copy THEN concat('CREATE TABLE dup.', w.id, ' (id INT)')
               WHEN w.k % 97 = 0 THEN concat('CREATE OR REPLACE VIEW ds', w.k % 7, '.', w.id, ' AS (SELECT FROM')
               WHEN w.k % 13 = 0 THEN b.sel
               ELSE concat('-- from not_a_table', chr(10), 'CREATE OR REPLACE ',
                 CASE WHEN w.k % 3 = 0 THEN 'VIEW' ELSE 'TABLE' END, ' ds', w.k % 7, '.', w.id, ' AS ', b.sel) END
             END AS content,
             coalesce(d.deps, '') AS deps, CAST(CASE WHEN w.active THEN 1 ELSE 0 END AS INTEGER) AS n_ctes,
             CASE WHEN w.type = 'unknown' THEN 'unbalanced parentheses' END AS error
           FROM all_nodes n LEFT JOIN win w ON w.id = n.id
             LEFT JOIN body b ON b.path = w.path
             LEFT JOIN (SELECT id, string_agg(dep, ' ' ORDER BY dep) AS deps FROM refs GROUP BY id) d ON d.id = n.id
             LEFT JOIN win o ON n.id = concat('cte:', o.id, ':c1')""",
        _FILES, _refs("win"), _EDGES, _SCRIPT_TEXT,
    ),
    "layer_options": _files(
        """SELECT concat('gold_root/staging/', path) AS path, layer, 'bronze' AS alias_layer FROM rec"""
    ),
    "lineage_of": _closed("SELECT seed, id FROM lin", _PICKED, _LINEAGE),
    "upstream_tree": _closed(
        "SELECT id FROM seeds UNION SELECT p.anc FROM seeds s JOIN pairs p ON p.node = s.id", _SEEDS
    ),
    "focus_tree": _closed(
        "SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM lin)", _SEEDS, _LINEAGE
    ),
    "select_tree": _closed(
        "SELECT id, id IN (SELECT id FROM lin) AS selected FROM nodes", _SEEDS, _LINEAGE
    ),
    "visible_nodes": _graph("SELECT id, layer = 'silver' OR type = 'view' AS hidden FROM nodes"),
    "edge_role": _graph(
        """SELECT edge_id, source, target, CASE WHEN target = 't3' THEN 'incoming'
             WHEN source = 't3' THEN 'outgoing' ELSE 'other' END AS role FROM edges"""
    ),
    "node_search": _files("SELECT id, label FROM win WHERE lower(label) LIKE '%t1%'"),
    "node_groups": _graph(
        """SELECT grp, id, label, count(*) OVER (PARTITION BY grp) AS n FROM (
             SELECT id, label, CASE WHEN layer IN ('cte', 'external') THEN layer ELSE 'standard' END AS grp
             FROM all_nodes)"""
    ),
    "source_nodes": _graph("SELECT id FROM nodes WHERE id NOT IN (SELECT target FROM edges)"),
    "topo_rank": _closed(
        """SELECT n.id, max(d.depth) AS rank, n.cyclic
           FROM comp n LEFT JOIN depths d ON d.rep = n.rep GROUP BY n.id, n.cyclic""",
        """loops AS (SELECT p.node, min(p.anc) AS rep FROM pairs p
             JOIN pairs q ON q.node = p.anc AND q.anc = p.node GROUP BY p.node)""",
        """comp AS (SELECT n.id, coalesce(l.rep, n.id) AS rep, l.rep IS NOT NULL AS cyclic
             FROM nodes n LEFT JOIN loops l ON l.node = n.id)""",
        """steps AS (SELECT DISTINCT s.rep AS source, t.rep AS target FROM edges e
             JOIN comp s ON s.id = e.source JOIN comp t ON t.id = e.target WHERE s.rep <> t.rep)""",
        """depths(rep, depth) AS (
             SELECT DISTINCT rep, 0 FROM comp WHERE rep NOT IN (SELECT target FROM steps)
             UNION SELECT e.target, d.depth + 1 FROM depths d JOIN steps e ON e.source = d.rep)""",
    ),
    "topo_rank_acyclic": _closed(
        """SELECT n.id, max(d.depth) AS rank, max(d.depth) IS NULL AS cyclic
           FROM nodes n LEFT JOIN depths d USING (id) GROUP BY n.id""",
        "cut AS (SELECT source, target FROM edges WHERE NOT (source = 't7' AND target = 't3'))",
        """depths(id, depth) AS (
             SELECT id, 0 FROM nodes WHERE id NOT IN (SELECT target FROM cut)
             UNION SELECT e.target, d.depth + 1 FROM depths d JOIN cut e ON e.source = d.id)""",
    ),
    "carry_positions": _graph(
        """SELECT id, layer, coalesce(CAST(p_size AS DOUBLE), 0) AS x, coalesce(p_retailprice, 0) AS y
           FROM all_nodes LEFT JOIN part ON id = concat('t', p_partkey)"""
    ),
    "snapshot_save": _graph("SELECT edge_id, source, target, kind FROM all_edges WHERE kind <> 'cte'"),
    "snapshot_load": _graph("SELECT id, label, layer, type, project, dataset, path FROM all_nodes"),
    "ghost_stub_sql": _graph(
        """SELECT concat(replace(id, '.', '/'), '.sql') AS path,
             concat('-- Created automatically for ', id, chr(10), chr(10), 'CREATE OR REPLACE TABLE `', id,
               '` AS', chr(10), 'SELECT', chr(10), '    -- Add columns here', chr(10), '    1 as id', chr(10)) AS content
           FROM ghosts"""
    ),
    "stub_admit": _graph(
        """SELECT concat(replace(id, '.', '/'), '.sql') AS path, 'ok' AS status FROM ghosts
           UNION ALL SELECT path, 'exists' FROM rec
           UNION ALL SELECT concat('../', path), 'invalid path' FROM rec"""
    ),
    # --- C
    "audit_orphans": _graph(
        """SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM edges)
           AND id NOT IN (SELECT target FROM edges)"""
    ),
    "audit_cycles": _closed("SELECT node AS id FROM pairs WHERE node = anc"),
    "audit_impact": _closed(
        """SELECT n.id, count(p.node) AS n FROM nodes n
           LEFT JOIN pairs p ON p.anc = n.id AND p.node <> n.id GROUP BY n.id"""
    ),
    "audit_layer_jumps": _graph(
        """SELECT source, target, source_layer, target_layer, step FROM (
             SELECT DISTINCT e.source, e.target, s.layer AS source_layer, t.layer AS target_layer,
               CASE t.layer WHEN 'bronze' THEN 1 WHEN 'silver' THEN 2 WHEN 'gold' THEN 3 END
               - CASE s.layer WHEN 'bronze' THEN 1 WHEN 'silver' THEN 2 WHEN 'gold' THEN 3 END AS step
             FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target)
           WHERE step NOT IN (0, 1)"""
    ),
    "audit_layer_matrix": _graph(
        """SELECT s.layer AS source_layer, t.layer AS target_layer, count(*) AS n
           FROM all_edges e JOIN all_nodes s ON s.id = e.source JOIN all_nodes t ON t.id = e.target
           GROUP BY 1, 2"""
    ),
    # --- D
    "bronze_ingest": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer",
    "bronze_typed_load": """
        SELECT CAST(event_id AS VARCHAR) AS log_id, CAST(user_id AS VARCHAR) AS user_id, ts AS log_time,
          CAST(ts AS DATE) AS log_date, value AS amount,
          CAST(json_extract_string(props, '$.k') AS INTEGER) AS props FROM events""",
    "bronze_rescued_load": """
        SELECT CAST(event_id AS INT) AS log_id, CASE WHEN event_id % 7 <> 0 THEN event_id END AS code,
          CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract(props, '$.k') AS INT) END AS k,
          CASE WHEN event_id % 7 = 0 THEN event_type END AS lost_code,
          CASE WHEN event_id % 11 = 0 THEN concat('{', event_type) END AS lost_doc FROM events""",
    "bronze_partitioned_write": """
        SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""",
    "select_all": "SELECT * FROM nation",
    "silver_clean": """
        SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate
        FROM orders WHERE o_orderpriority IS NOT NULL""",
    "silver_orders_cleaned": _q("SELECT * FROM cleaned", _CLEANED),
    "silver_region_case": """
        SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 0 THEN 'North America'
          WHEN c_nationkey IN (1, 2, 3) THEN 'Europe' ELSE 'Rest of World' END AS region FROM customer""",
    "silver_sessions": """
        SELECT user_id, concat(user_id, '-', CAST(ts AS DATE)) AS session_id, min(ts) AS session_start,
          max(ts) AS session_end, count(*) AS page_views FROM events GROUP BY 1, 2""",
    "gold_user_stats": """
        SELECT CAST(o_orderdate AS DATE) AS order_day, count(o_orderkey) AS total_users FROM orders GROUP BY 1""",
    "gold_daily_revenue": _q(
        """SELECT CAST(order_timestamp AS DATE) AS order_date, country,
             CAST(sum(CAST(total_amount AS DECIMAL(18, 3))) AS DOUBLE) AS revenue,
             count(DISTINCT order_id) AS total_orders
           FROM cleaned WHERE status = 'O' GROUP BY 1, 2""",
        _CLEANED,
    ),
    "gold_monthly_revenue": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
          CAST(sum(CAST(o_totalprice + 0.125 AS DECIMAL(18, 3))) AS DOUBLE) AS total_revenue FROM orders GROUP BY 1""",
    "gold_product_performance": """
        SELECT concat('SKU-', l_partkey) AS product_id, CAST(sum(q) AS DOUBLE) AS units_sold,
          CAST(sum(q * CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue,
          count(*) FILTER (l_linenumber = 7) AS unreadable
        FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN CAST(1.125 AS DECIMAL(18, 3))
                ELSE CAST(l_quantity AS DECIMAL(18, 3)) END AS q FROM lineitem) GROUP BY 1""",
    "gold_conversion_funnel": """
        WITH s AS (
          SELECT user_id, concat(user_id, '-', CAST(ts AS DATE)) AS session_id, min(ts) AS session_start,
            max(ts) AS session_end FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2)
        SELECT s.user_id, count(DISTINCT s.session_id) AS total_sessions,
          count(DISTINCT o.event_id) AS total_orders,
          coalesce(count(DISTINCT o.event_id) / nullif(count(DISTINCT s.session_id), 0), 0) AS conversion_rate
        FROM s LEFT JOIN events o ON o.event_type = 'purchase' AND s.user_id = o.user_id
          AND o.ts BETWEEN s.session_start AND s.session_end
        GROUP BY 1""",
    "gold_campaign_ctr": """
        SELECT n_nationkey AS campaign_id, count(c_custkey) AS impressions, count(s_suppkey) AS clicks,
          count(s_suppkey) / nullif(count(c_custkey), 0) AS ctr
        FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
          LEFT JOIN supplier ON s_nationkey = n_nationkey
        GROUP BY 1""",
    "ops_delayed": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'",
    "create_or_replace": """SELECT *, 1 AS version FROM customer WHERE c_acctbal < 5000
        UNION ALL SELECT *, 2 FROM customer WHERE c_acctbal < 0""",
    "medallion_mart": _q(
        """SELECT CAST(order_timestamp AS DATE) AS order_date,
             CASE WHEN country = 0 THEN 'North America' WHEN country IN (1, 2, 3) THEN 'Europe'
                  ELSE 'Rest of World' END AS region,
             CAST(sum(CAST(total_amount AS DECIMAL(18, 3))) AS DOUBLE) AS revenue,
             count(DISTINCT order_id) AS total_orders
           FROM cleaned WHERE status = 'O' GROUP BY 1, 2""",
        _CLEANED,
    ),
}

# A refreshed graph is the graph of the scripts as they are.
ORACLES["graph_refresh"] = ORACLES["node_table"]

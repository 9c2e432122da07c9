"""What one script reads, case by case."""

import pytest

from lineloom.operators.parse import RECORD, parse_scripts, table_refs

CASES = [
    # name, dialect, path, text, expected references
    ("comma", "bigquery", "x/f.sql", "SELECT 1 FROM a.b x, c d", ["a.b", "c"]),
    ("extract", "bigquery", "x/f.sql", "SELECT EXTRACT(DAY FROM ts) FROM a", ["a"]),
    (
        "subquery", "bigquery", "x/f.sql",
        "SELECT 1 FROM (SELECT 1 FROM e JOIN `p.q.r` z ON z.id = e.id) s WHERE k IN (1, 2)",
        ["e", "p.q.r"],
    ),
    ("unnest", "bigquery", "x/f.sql", "SELECT 1 FROM a, UNNEST(a.items) u", ["a"]),
    ("comments", "bigquery", "x/f.sql", "-- from x\nSELECT 1 FROM a # from y", ["a"]),
    ("block comment", "bigquery", "x/f.sql", "SELECT 1 /* from x ' */ FROM a /* open from y", ["a"]),
    ("comment with quote", "bigquery", "x/f.sql", "-- don't\nSELECT 1 FROM a -- it's", ["a"]),
    ("comment mark in literal", "bigquery", "x/f.sql", "SELECT '--' FROM a", ["a"]),
    ("literal", "bigquery", "x/f.sql", "SELECT 'from x' FROM a", ["a"]),
    ("escaped quote", "bigquery", "x/f.sql", r"SELECT 'it\'s from x' FROM a", ["a"]),
    ("doubled quote", "postgres", "x/f.sql", "SELECT 'it''s from x' FROM a", ["a"]),
    ("triple quote", "bigquery", "x/f.sql", "SELECT '''it's from x''' FROM a", ["a"]),
    ("dollar quote", "postgres", "x/f.sql", "SELECT $q$ from x ' $q$ FROM a", ["a"]),
    ("distinct from", "bigquery", "x/f.sql", "SELECT a IS DISTINCT FROM b FROM t", ["t"]),
    ("cte", "bigquery", "x/f.sql", "WITH c AS (SELECT 1 FROM x) SELECT 1 FROM c", ["cte:f:c", "x"]),
    (
        "two ctes", "bigquery", "x/f.sql",
        "WITH c AS (SELECT 1 FROM x), d (k) AS (SELECT 1 FROM c, y) SELECT 1 FROM d WHERE k IN (SELECT k FROM z)",
        ["cte:f:c", "cte:f:d", "x", "y", "z"],
    ),
    ("recursive", "postgres", "x/f.sql", "WITH RECURSIVE c AS (SELECT 1 FROM x UNION ALL SELECT 1 FROM c) SELECT * FROM c", ["cte:f:c", "x"]),
    ("with offset", "bigquery", "x/f.sql", "SELECT 1 FROM a, UNNEST(a.i) u WITH OFFSET AS o, b", ["a", "b"]),
    ("named window", "bigquery", "x/f.sql", "SELECT sum(v) OVER w FROM a WINDOW w AS (PARTITION BY k, j)", ["a"]),
    ("self", "bigquery", "x/f.sql", "CREATE TABLE s.t AS SELECT 1 FROM r.t", []),
    ("ddl named as its file", "bigquery", "x/t.sql", "CREATE TABLE s.t (id INT)", []),
    ("ddl named otherwise", "bigquery", "x/f.sql", "CREATE TABLE s.t (id INT)", ["s.t"]),
    ("two names", "bigquery", "x/f.sql", "SELECT 1 FROM u JOIN d.u ON true", ["d.u", "u"]),
    ("parenthesised join", "bigquery", "x/f.sql", "SELECT 1 FROM (a JOIN b ON a.k = b.k), c", ["a", "b", "c"]),
    ("comma after on", "bigquery", "x/f.sql", "SELECT 1 FROM a JOIN b ON a.k = b.k, c GROUP BY x, y", ["a", "b", "c"]),
    ("comma after using", "bigquery", "x/f.sql", "SELECT 1 FROM a JOIN b USING (k, j), c", ["a", "b", "c"]),
    ("lateral", "postgres", "x/f.sql", "SELECT 1 FROM a, LATERAL (SELECT 1 FROM b) s, c", ["a", "b", "c"]),
    ("lateral view", "spark", "x/f.sql", "SELECT 1 FROM a LATERAL VIEW explode(m) t AS k, v WHERE v > 1", ["a"]),
    ("table function", "postgres", "x/f.sql", "SELECT 1 FROM generate_series(1, 3) g, a", ["a"]),
    ("trim", "postgres", "x/f.sql", "SELECT trim(BOTH 'x' FROM c) FROM a", ["a"]),
    ("union", "bigquery", "x/f.sql", "SELECT p, q FROM a UNION ALL SELECT r, s FROM b ORDER BY 1, 2", ["a", "b"]),
    ("insert", "bigquery", "x/f.sql", "INSERT INTO s.t (k, v) SELECT k, v FROM a", ["a", "s.t"]),
    ("update", "postgres", "x/f.sql", "UPDATE s.t SET x = 1, y = 2 FROM a WHERE true", ["a", "s.t"]),
    ("delete", "postgres", "x/f.sql", "DELETE FROM s.t USING a WHERE true", ["a", "s.t"]),
    (
        "merge", "bigquery", "x/f.sql",
        "MERGE INTO s.t USING (SELECT 1 FROM a) u ON true WHEN MATCHED THEN UPDATE SET p = 1, q = 2",
        ["a", "s.t"],
    ),
    ("like table", "bigquery", "x/f.sql", "CREATE TABLE s.n LIKE s.o", ["s.o"]),
    ("references", "postgres", "x/t.sql", "CREATE TABLE t (id INT REFERENCES other (id))", ["other"]),
    ("if not exists", "bigquery", "x/f.sql", "CREATE TABLE IF NOT EXISTS s.t AS SELECT 1 FROM a", ["a"]),
    ("first statement only", "bigquery", "x/f.sql", "SELECT 1 FROM a; SELECT 1 FROM b", ["a"]),
    ("double quotes", "postgres", "x/f.sql", 'SELECT "from x" FROM "My Schema"."T a" z', ["My Schema.T a"]),
    ("double quotes are text", "bigquery", "x/f.sql", 'SELECT "from x" FROM a', ["a"]),
    ("brackets", "tsql", "x/f.sql", "SELECT [from x] FROM [dbo].[T a]", ["dbo.T a"]),
    ("back-quoted parts", "spark", "x/f.sql", "SELECT 1 FROM `a`.`b`", ["a.b"]),
    ("dashed project", "bigquery", "x/f.sql", "SELECT a-b FROM my-proj-1.d.t", ["my-proj-1.d.t"]),
    ("slashes", "snowflake", "x/f.sql", "SELECT 1 // from x\nFROM a", ["a"]),
    ("from first", "duckdb", "x/f.sql", "SELECT 1 FROM (FROM a SELECT k) z", ["a"]),
    ("file as table", "duckdb", "x/f.sql", "SELECT 1 FROM 'd.parquet'", ["d.parquet"]),
    ("case and spacing", "bigquery", "x/f.sql", "sElEcT 1 fRoM\n\t a . b\nInNeR jOiN c oN true", ["a.b", "c"]),
    ("unicode", "bigquery", "x/f.sql", "SELECT 1 FROM größe, 表", ["größe", "表"]),
]


@pytest.fixture(scope="module")
def refs(spark):
    """All cases of one dialect in one job."""
    out = {}
    for dialect in {c[1] for c in CASES}:
        rows = [(f"case{i}/{c[2]}", c[3]) for i, c in enumerate(CASES) if c[1] == dialect]
        df = spark.createDataFrame(rows, "path string, content string")
        for r in parse_scripts(df, dialect).collect():
            out[r["path"]] = r
    return out


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_references(refs, i):
    record = refs[f"case{i}/{CASES[i][2]}"]
    assert record["error"] is None
    assert record["dependencies"] == sorted(CASES[i][4])


BROKEN = {
    "": "no statement",
    "-- nothing": "no statement",
    "SELECT (1 FROM a": "unbalanced parentheses",
    "SELECT 1) FROM a": "unbalanced parentheses",
    "SELECT (1; SELECT 2)": "unbalanced parentheses",
    "SELECT 'open FROM a": "unclosed literal or quoted name",
    "SELECT `open FROM a": "unclosed literal or quoted name",
    "hello there world": "unknown statement",
    "SELECT 1 FROM WHERE x": "FROM or JOIN without a table",
    "SELECT 1 FROM a JOIN": "FROM or JOIN without a table",
    "SELECT 1 FROM {{ ref('x') }}": "FROM or JOIN without a table",
    "CREATE TABLE": "CREATE without a target",
}


def test_broken_scripts_keep_a_row(spark):
    texts = list(BROKEN)
    df = spark.createDataFrame([(f"gold/b{i}.sql", t) for i, t in enumerate(texts)], "path string, content string")
    rows = parse_scripts(df).orderBy("path").collect()
    assert len(rows) == len(texts)
    for r in rows:
        i = int(r["id"][1:])
        assert r["error"] == BROKEN[texts[i]], texts[i]
        assert (r["type"], r["project"], r["dataset"], r["layer"]) == ("unknown", "n/a", "n/a", "gold")
        assert r["dependencies"] == [] and r["ctes"] == {} and r["label"] == r["id"]
        assert r["content"] == texts[i]


TARGETS = [
    # path, text, (project, dataset, label, type)
    ("w/bronze/x.sql", "CREATE TABLE p.d.t AS SELECT 1", ("p", "d", "t", "table")),
    ("w/bronze/x.sql", "CREATE OR REPLACE VIEW d.t AS SELECT 1", ("default", "d", "t", "view")),
    ("w/bronze/x.sql", "CREATE MATERIALIZED VIEW t AS SELECT 1", ("default", "default", "t", "view")),
    ("w/sales/x.sql", "CREATE TABLE t AS SELECT 1", ("default", "sales", "t", "table")),
    ("w/Silver/x.sql", "SELECT 1", ("default", "default", "x", "table")),
    ("w/sales/x.sql", "SELECT 1", ("default", "sales", "x", "table")),
    ("w/gold/d.x.sql", "SELECT 1", ("default", "d", "x", "table")),
    ("w/gold/p.d.x.sql", "CREATE TABLE t AS SELECT 1", ("p", "d", "x", "table")),
    ("w/gold/p.d.x.sql", "CREATE TABLE e.t AS SELECT 1", ("default", "e", "t", "table")),
    ("w/gold/a.b.c.x.sql", "SELECT 1", ("default", "default", "a.b.c.x", "table")),
    ("w/gold/x.sql", "CREATE TABLE p.d.t (k INT)", ("default", "default", "x", "table")),
    ("w/sales/x.sql", "CREATE VIEW p.d.t (k) AS SELECT 1", ("default", "sales", "x", "view")),
    ("w/gold/x.sql", "CREATE TABLE IF NOT EXISTS `p.d.t` AS SELECT 1", ("p", "d", "t", "table")),
    ("w/sales/x.sql", "CREATE FUNCTION d.f(a INT) AS (a + 1)", ("default", "sales", "x", "table")),
]


def test_targets(spark):
    rows = [(str(i) + "/" + p, t) for i, (p, t, _) in enumerate(TARGETS)]
    got = parse_scripts(spark.createDataFrame(rows, "path string, content string")).collect()
    for r in got:
        want = TARGETS[int(r["path"].split("/")[0])][2]
        assert (r["project"], r["dataset"], r["label"], r["type"]) == want, r["path"]


def test_cte_bodies_are_the_raw_text(spark):
    text = "WITH a AS (\n  SELECT (1) /* k ) */ FROM x\n),\nb AS (SELECT ')' FROM a) SELECT * FROM b"
    row = parse_scripts(spark.createDataFrame([("d/f.sql", text)], "path string, content string")).first()
    assert row["ctes"] == {"a": "SELECT (1) /* k ) */ FROM x", "b": "SELECT ')' FROM a"}


def test_qualified_matching(spark):
    rows = [
        ("x/a.sql", "CREATE TABLE s.t AS SELECT 1 FROM r.t JOIN s.t ON true"),
        ("x/b.sql", "WITH c AS (SELECT 1) SELECT 1 FROM c JOIN s.c ON true"),
    ]
    df = spark.createDataFrame(rows, "path string, content string")
    got = {r["id"]: r["dependencies"] for r in parse_scripts(df, match="qualified").collect()}
    assert got == {"a": ["r.t"], "b": ["cte:b:c", "s.c"]}


def test_long_texts_are_read_whole(spark):
    """One long script: many names, a long literal and a long comment."""
    n = 3000
    text = (
        "SELECT '" + "from lie " * 20000 + "' /* " + "from lie ' " * 20000 + " */ FROM t0"
        + "".join(f" JOIN d.t{i} ON (t0.k = t{i}.k)" for i in range(1, n))
    )
    df = spark.createDataFrame([("x/f.sql", text)], "path string, content string")
    deps = {r["dep"] for r in table_refs(parse_scripts(df)).collect()}
    assert deps == {"t0"} | {f"d.t{i}" for i in range(1, n)}


def test_bad_arguments(spark):
    df = spark.createDataFrame([("x/f.sql", "SELECT 1")], "path string, content string")
    for kwargs in ({"dialect": "cobol"}, {"match": "fuzzy"}, {"columns": ("id", "nope")}):
        with pytest.raises(ValueError):
            parse_scripts(df, **kwargs)
    assert parse_scripts(df).columns == list(RECORD)


DEEP = 50


@pytest.mark.parametrize(
    "content, refs",
    [
        ("SELECT 1 FROM a " + "/* from x " * DEEP + "*/ " * DEEP + " JOIN b ON true", ["a", "b"]),
        ("/* it's /* from x */ \"still */ SELECT 1 FROM a /* /*/ */ from y */ , b", ["a", "b"]),
        ("SELECT '/* /* ' FROM a -- /* from x\n JOIN b ON '*/' = '/*'", ["a", "b"]),
        ("SELECT $t$ /* $t$, $$/*$$ FROM a /* $t$ /* */ */ JOIN \"q/*\" ON true", ["a", "q/*"]),
        ("SELECT 1 FROM a /* open /* twice */ from x", ["a"]),
        ("SELECT 1 FROM a /* one */ JOIN b ON true /* two **/", ["a", "b"]),
    ],
)
def test_nested_comments_of_any_depth(spark, content, refs):
    df = spark.createDataFrame([("x/f.sql", content)], "path string, content string")
    got = parse_scripts(df, "postgres", columns=RECORD).first()
    assert got["error"] is None and got["dependencies"] == refs

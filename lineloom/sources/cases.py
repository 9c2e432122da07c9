"""Kinds of script that are easily misread, one per key, each in its dialect.

What each kind must give stands beside its text; the SQL oracle is made from those statements, never
from the engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Case:
    """``{k}`` stands for the key.  ``refs`` are sorted; a broken script has an error instead."""

    dialect: str
    text: str
    refs: str = ""
    type: str = "table"
    label: str = "s{k}"
    error: str = ""


def _bad(dialect: str, text: str, error: str) -> Case:
    return Case(dialect, text, "", "unknown", "s{k}", error)


_LONG = " ".join(f"opt{i}" for i in range(40))

CASES = (
    Case("bigquery", "SELECT 1 FROM a{k} JOIN b ON CASE WHEN a{k}.x = 1 THEN 1 ELSE 2 END = 1, c{k}", "a{k} b c{k}"),
    Case("postgres", "SELECT 1 FROM a{k} JOIN b ON window = 1, c{k}", "a{k} b c{k}"),
    Case("postgres", "SELECT 1 FROM a{k} JOIN b ON b.v = limit, c{k} WHERE x > 1", "a{k} b c{k}"),
    Case("bigquery", "SELECT 1 FROM p.d.ev_*, d{k}.t", "d{k}.t p.d.ev_*"),
    Case("bigquery", "SELECT n_*2 FROM d{k}.t", "d{k}.t"),
    Case("tsql", "SELECT 1 FROM #tmp{k} t JOIN [dbo].[T{k}] u ON 1 = 1", "#tmp{k} dbo.T{k}"),
    Case("tsql", "CREATE TABLE #w{k} AS SELECT 1 FROM s{k}x.t", "s{k}x.t", "table", "#w{k}"),
    Case("postgres", "SELECT 1 /* a /* from b{k} */ from c{k} */ FROM d{k}", "d{k}"),
    Case("postgres", "/* a /* b /* c */ */ x */ SELECT 1 FROM d{k}", "d{k}"),
    Case("postgres", "SELECT 1 FROM d{k} " + "/* it's from x{k} " * 50 + "*/ " * 50 + ", e{k}", "d{k} e{k}"),
    Case("tsql", "SELECT '/* /* ' FROM a{k} /* [ /* ' */ from x{k} */ , [b/*{k}]", "a{k} b/*{k}"),
    Case("mysql", "SELECT 1 # from x{k}\nFROM `a{k}`.`t`", "a{k}.t"),
    Case("postgres", "SELECT 1 FROM a{k} CONNECT BY PRIOR x = y", "a{k}"),
    Case("postgres", 'SELECT 1 FROM "h"."s{k}"."t", u{k}', "h.s{k}.t u{k}"),
    Case("mysql", "INSERT OVERWRITE TABLE w{k} SELECT 1 FROM `d`.e{k}", "d.e{k} w{k}"),
    Case("tsql", "SELECT 1 FROM [a b{k}], [c{k}]", "a b{k} c{k}"),
    Case("snowflake", "SELECT 1 FROM @stage{k}/p, t{k}x", "t{k}x"),
    Case("postgres", "REVOKE SELECT ON t{k} FROM u{k}"),
    Case("postgres", "SELECT 1 FROM a{k}, ROWS FROM (f(1)) x", "a{k}"),
    Case("postgres", "VACUUM ANALYZE t{k}"),
    Case("snowflake", "CREATE PIPE p{k} AS COPY INTO t FROM @st"),
    Case("bigquery", "CREATE " + _LONG + " VIEW d.v{k} AS SELECT 1 FROM a{k}", "a{k}", "view", "v{k}"),
    Case("bigquery", "MERGE INTO m{k} USING (SELECT 1 FROM a{k}) u ON CASE WHEN 1 = 1 THEN TRUE END WHEN NOT MATCHED THEN INSERT (p, q) VALUES (1, 2)", "a{k} m{k}"),
    Case("postgres", "DELETE FROM a{k} USING b{k} WHERE 1 = 1", "a{k} b{k}"),
    Case("bigquery", "SELECT 1 FROM (SELECT 1 FROM a{k}, (SELECT 1 FROM b{k}) q) r, c{k}", "a{k} b{k} c{k}"),
    Case("bigquery", "SELECT a, b, FROM t{k}x", "t{k}x"),
    _bad("bigquery", "", "no statement"),
    _bad("bigquery", "-- only {k}", "no statement"),
    _bad("postgres", "SELECT 'open{k} FROM a", "unclosed literal or quoted name"),
    _bad("bigquery", "SELECT (1 FROM a{k}", "unbalanced parentheses"),
    _bad("bigquery", "hello there {k}", "unknown statement"),
    _bad("bigquery", "SELECT 1 FROM a{k} JOIN", "FROM or JOIN without a table"),
    _bad("bigquery", "CREATE TABLE", "CREATE without a target"),
    _bad("postgres", "SELECT a,, b FROM t{k}", "misplaced comma"),
    _bad("postgres", "SELECT a, FROM t{k}", "misplaced comma"),
    _bad("bigquery", "SELECT a FROM t{k} WHERE", "clause without content"),
    _bad("bigquery", "SELECT a FROM t{k} GROUP a", "GROUP or ORDER without BY"),
    _bad("bigquery", "SELECT a b c d FROM t{k}", "names side by side"),
)


def case_scripts(keys: DataFrame, key: str, dialect: str) -> DataFrame:
    """``(path, content)`` of the keys whose kind is of this dialect: key k has kind k mod the number of kinds."""
    k = F.col(key)
    texts = F.array(*[F.lit(c.text) for c in CASES])
    dialects = F.array(*[F.lit(c.dialect) for c in CASES])
    kind = (k % len(CASES)).cast("int")
    mine = keys.where(F.get(dialects, kind) == dialect)
    return mine.select(
        F.concat(F.lit("case/s"), k.cast("string"), F.lit(".sql")).alias("path"),
        F.replace(F.get(texts, kind), F.lit("{k}"), k.cast("string")).alias("content"),
    )


def case_oracle() -> str:
    """What ``script_cases`` must return, as SQL over ``part``."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n  ".join(f"({i}, {text(c.type)}, {text(c.label)}, {text(c.refs)}, {text(c.error)})" for i, c in enumerate(CASES))
    fill = lambda c: f"replace({c}, '{{k}}', CAST(p_partkey AS VARCHAR))"
    return f"""WITH kinds(kind, type, label, refs, error) AS (VALUES
  {rows})
SELECT concat('case/s', p_partkey, '.sql') AS path, type, {fill("label")} AS label, {fill("refs")} AS refs, error
FROM part JOIN kinds ON kind = p_partkey % {len(CASES)}"""

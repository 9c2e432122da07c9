"""Compare a Spark result with DuckDB on the same Parquet tables."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime) and v.tzinfo is not None:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return _rows([d[0] for d in cur.description], cur.fetchall())


def difference(left, right) -> str | None:
    """None when equal, else a short account of the first difference."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        extra = sorted(set(left[1]) - set(right[1]), key=str)[:3]
        missing = sorted(set(right[1]) - set(left[1]), key=str)[:3]
        return f"rows {len(left[1])} != {len(right[1])}; extra {extra}; missing {missing}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"row {a} != {b}"
    return None


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()

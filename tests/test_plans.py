"""The physical plans that matter at scale."""

import re

import pytest
from compare import plan_of

from lineloom.operators.parse import LIGHT, parse_scripts, table_refs
from lineloom.operators import closure, condense
from lineloom.plans.catalog import QUERIES
from lineloom.sources import tables


def test_reading_scripts_needs_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([("x/f.sql", "SELECT 1 FROM a")], "path string, content string")
    plan = plan_of(table_refs(parse_scripts(df, columns=LIGHT)).where("dep <> 'q'"))
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("regexp_extract_all") == 1, "the text is scanned once"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("gold_user_stats", "o_orderkey:bigint,o_orderdate:timestamp_ntz"),
        ("silver_region_case", "c_custkey:bigint,c_nationkey:int"),
        ("gold_monthly_revenue", "o_totalprice:double,o_orderdate:timestamp_ntz"),
    ],
)
def test_only_needed_columns_are_read(spark, small, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan_of(QUERIES[name](spark, small))


@pytest.mark.parametrize(
    "name, filters",
    [
        ("ops_delayed", "EqualTo(l_returnflag,R)"),
        ("gold_daily_revenue", "EqualTo(o_orderstatus,O)"),
        ("medallion_mart", "EqualTo(o_orderstatus,O)"),
        ("gold_conversion_funnel", "EqualTo(event_type,purchase)"),
    ],
)
def test_filters_reach_the_scan(spark, small, name, filters):
    assert filters in plan_of(QUERIES[name](spark, small))


def test_aggregates_combine_before_the_shuffle(spark, small):
    for name in ("silver_sessions", "gold_monthly_revenue", "parse_summary"):
        plan = plan_of(QUERIES[name](spark, small))
        assert re.search(r"Exchange hashpartitioning.*\n.*Aggregate\(", plan), name


def test_partitioned_write_rebalances(spark):
    assert "REBALANCE_PARTITIONS_BY_COL" in plan_of(spark.range(9).withColumnRenamed("id", "day").hint("rebalance", "day"))


@pytest.fixture
def jobs(monkeypatch):
    """The plans of everything a loop writes, and how many rows each table has."""
    seen = []
    real = closure.materialize

    def watched(df, label, **metrics):
        stored, observed = real(df, label, **metrics)
        seen.append((label, plan_of(df), stored.count()))
        return stored, observed

    monkeypatch.setattr(closure, "materialize", watched)
    monkeypatch.setattr(condense, "materialize", watched)
    return seen


def _ladder(spark, n):
    links = [(f"n{i}", f"n{i + 1}") for i in range(n)] + [(f"n{i}", f"n{i + 2}") for i in range(n - 1)]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n + 1)], "id string")
    return nodes, spark.createDataFrame(links, "source string, target string")


def test_jobs_of_the_loops(spark, jobs):
    nodes, edges = _ladder(spark, 40)
    closure.closure(edges)
    closure.upstream_tree(edges, nodes)
    closure.topo_rank(nodes, edges)
    for label, plan, _ in jobs:
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Window"):
            assert bad not in plan, label
    labels = [label for label, _, _ in jobs]
    assert labels.count("pairs") <= 8, "distances double"
    assert labels.count("rank") <= 3 + 44 // 4, "several levels are ranked per job"


def test_trees_carry_no_seeds(spark, jobs):
    nodes, edges = _ladder(spark, 40)
    assert closure.select_tree(nodes, edges, nodes).where("selected").count() == 41
    assert sum(n for label, _, n in jobs if label == "reach") <= 2 * 41


def test_nothing_is_cut_by_local_checkpoint():
    import pathlib

    for f in pathlib.Path(tables.__file__).parent.parent.rglob("*.py"):
        assert "localCheckpoint" not in f.read_text(encoding="utf-8")

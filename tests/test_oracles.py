"""Every registered query against its SQL oracle in DuckDB, on whole tables."""

import compare
import pytest

import __spark_entry__ as entry
from lineloom.plans.catalog import QUERIES
from lineloom.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def duck(small):
    return compare.connect(small)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = compare.spark_rows(QUERIES[name](spark, small))
    want = compare.duck_rows(duck, ORACLES[name])
    assert compare.difference(got, want) is None
    assert got[1], "an empty result proves nothing"


def test_entry(spark):
    df = entry.entry(spark)
    assert {"id", "direct_count", "nested_count"} <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", ["node_groups", "folder_list"])
def test_sorted_results_are_sorted(spark, small, name):
    rows = [tuple(r) for r in QUERIES[name](spark, small).collect()]
    assert rows == sorted(rows)

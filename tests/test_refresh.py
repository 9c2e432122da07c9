"""A refreshed graph against the graph built from nothing."""

import random

import pytest
from pyspark.sql import functions as F

from lineloom.plans.lineage import full_graph
from lineloom.plans.refresh import graph_load, refresh
from lineloom.sources import versions


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SCHEMA = "path string, content string"


def _made(rng, k):
    reads = [f"t{rng.randrange(40)}" for _ in range(rng.randrange(1, 4))] + ["ext.raw"] * rng.randrange(2)
    body = " JOIN ".join(rng.choice(("", "ds.")) + r if r[0] == "t" else r for r in reads)
    head = rng.choice((f"CREATE TABLE ds.t{k} AS ", f"CREATE VIEW t{k} AS ", "WITH c AS (SELECT 1 FROM z) "))
    return head + f"SELECT * FROM {body}" + (" JOIN c" if "WITH" in head else "")


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def _check(spark, scripts, place, **options):
    df = spark.createDataFrame(sorted(scripts.items()), SCHEMA)
    got = refresh(df, place, **options)
    nodes, edges = full_graph(df, **({"discovery": True} | options))
    assert _rows(got.nodes) == _rows(nodes) and _rows(got.edges) == _rows(edges)
    assert _rows(graph_load(spark, place, "nodes")) == _rows(nodes)
    return got


def test_refresh_equals_a_full_build(spark, tmp_path):
    rng, place = random.Random(5), str(tmp_path / "g")
    scripts = {f"wh/gold/t{k}.sql": _made(rng, k) for k in range(0, 36)}
    scripts["wh/bronze/t3.sql"] = "SELECT 1 FROM ext.other"
    frame = lambda: spark.createDataFrame(sorted(scripts.items()), SCHEMA)
    first = refresh(frame(), place)
    assert first.parsed == 37 and first.chars == sum(map(len, scripts.values()))
    same = refresh(frame(), place)
    assert (same.parsed, same.chars, same.resolved, same.counted) == (0, 0, 0, 0)
    # Changed, gone (a copy wins), new (a missing name appears, one is taken over), broken, turned into a cycle.
    scripts["wh/gold/t1.sql"] = _made(rng, 1) + " JOIN t2"
    del scripts["wh/gold/t3.sql"], scripts["wh/gold/t8.sql"]
    scripts["wh/gold/t38.sql"] = "CREATE TABLE ext.raw AS SELECT * FROM t1"
    scripts["wh/silver/zz.sql"] = "CREATE VIEW ds.t20 AS SELECT * FROM t21"
    scripts["wh/gold/t5.sql"] = "SELECT ( FROM"
    scripts["wh/gold/t6.sql"] = "SELECT * FROM t6x, t7"
    scripts["wh/gold/t7.sql"] = "SELECT * FROM ds.t6"
    second = _check(spark, scripts, place)
    assert second.parsed == 6
    for k in rng.sample(range(40), 3):
        scripts[f"wh/{rng.choice(('gold', 'a/b'))}/t{k}.sql"] = _made(rng, k)
    _check(spark, scripts, place)
    assert len(versions.versions(spark, place)) == 3
    # Other settings build anew; without scripts nothing is left.
    assert refresh(frame(), place, discovery=False).parsed == len(scripts)
    empty = refresh(spark.createDataFrame([], SCHEMA), place, discovery=False)
    assert empty.nodes.count() == empty.edges.count() == empty.parsed == 0


def test_one_percent_changed_parses_one_percent(spark, tmp_path):
    place = str(tmp_path / "g")
    text = lambda k, more: F.concat(F.lit("SELECT * FROM t"), F.floor(k / 2).cast("string"), more)
    make = lambda more: spark.range(1, 2001).select(F.concat(F.lit("w/t"), F.col("id").cast("string"), F.lit(".sql")).alias("path"), text(F.col("id"), more).alias("content"))
    whole = refresh(make(F.lit("")), place)
    part = refresh(make(F.when(F.col("id") > 1980, " JOIN ext.new").otherwise("")), place)
    assert whole.parsed == 2000 and part.parsed == part.resolved == part.counted == 20
    assert part.chars < 0.02 * whole.chars
    assert part.nodes.where("id = 'ext.new'").count() == 1


def test_a_failed_refresh_changes_nothing(spark, tmp_path):
    place = str(tmp_path / "g")
    good = spark.createDataFrame([("a.sql", "SELECT 1 FROM b")], SCHEMA)
    refresh(good, place)
    with pytest.raises(Exception, match="stop"):
        refresh(good.withColumn("content", F.raise_error(F.lit("stop")).cast("string")), place)
    assert {r["id"] for r in graph_load(spark, place, "nodes").collect()} == {"a", "b"}

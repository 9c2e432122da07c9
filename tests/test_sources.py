"""Scanning folders, snapshots, tables."""

import datetime
import os

import compare
import pytest

from lineloom.operators.parse import parse_scripts
from lineloom.sources import snapshots, tables, versions
from lineloom.sources.scripts import relative_path, script_paths, script_scan

from pyspark.sql import functions as F


def test_script_scan_reads_every_script(spark, tmp_path):
    texts = {
        "top.sql": "SELECT 1 FROM a\n-- end\n",
        "silver/x y+z%.sql": "SELECT 'ü'\nFROM b",
        "silver/deep/er/q.sql": "-- nothing here\n",
        "silver/empty.sql": "",
        "notes.txt": "not a script",
        ".hidden/h.sql": "SELECT 1",
        "_models/deep/_m.sql": "SELECT 2",
        "_x.sql": "SELECT 3",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = script_scan(spark, str(tmp_path))
    rel = found.select(relative_path(F.col("path"), str(tmp_path)).alias("path"), "content")
    got = {r["path"]: r["content"] for r in rel.collect()}
    assert got == {k: t for k, t in texts.items() if k.endswith(".sql")}
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "crlf.sql").write_bytes(b"-- x\r\nSELECT 1 -- y\rFROM a\xff")
    odd = script_scan(spark, str(tmp_path / "odd")).first()
    assert odd["content"] == "-- x\nSELECT 1 -- y\nFROM a\ufffd"
    parsed = {r["id"]: r for r in parse_scripts(found).collect()}
    assert parsed["empty"]["error"] == "no statement" and parsed["_m"]["error"] is None
    assert parsed["x y+z%"]["layer"] == "silver" and parsed["x y+z%"]["dependencies"] == ["b"]


def test_names_that_listings_mistake(spark, tmp_path):
    odd = ["a; isDirectory=true.sql", "{path=x; isDirectory=false; length=0}.sql", "b[1]*?.sql", "c, d.sql", "e%20f#g.sql"]
    for name in odd:
        (tmp_path / "x; isDirectory=true" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "x; isDirectory=true" / name).write_text(f"SELECT 1 FROM t -- {name}")
    (tmp_path / "folder.sql").mkdir()
    (tmp_path / "folder.sql" / "inner.ddl").write_text("SELECT 2")
    (tmp_path / "up").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "linked.sql").symlink_to(tmp_path / "folder.sql" / "inner.ddl")
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in script_scan(spark, str(tmp_path)).collect()}
    assert got == {n: f"SELECT 1 FROM t -- {n}" for n in odd} | {"linked.sql": "SELECT 2"}
    paths = script_paths(spark, f"file:{tmp_path}", "*.{ddl,txt}").collect()
    assert [(r["path"], r["bytes"]) for r in paths] == [(f"{tmp_path}/folder.sql/inner.ddl", 8)]
    (tmp_path / "none").mkdir()
    assert script_scan(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        script_scan(spark, str(tmp_path / "absent"))


def test_a_folder_of_a_hundred_thousand_files(spark, tmp_path):
    for k in range(100_000):
        os.close(os.open(tmp_path / f"f{k}.sql", os.O_CREAT | os.O_WRONLY))
    (tmp_path / "f5.sql").write_text("SELECT 5")
    found = script_scan(spark, str(tmp_path))
    assert found.agg(F.count("path"), F.count_distinct("path"), F.max("content")).first() == (100_000, 100_000, "SELECT 5")


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_snapshots(spark, tmp_path, fmt):
    base = str(tmp_path)
    nodes = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    load = lambda part, schema, name="one": snapshots.snapshot_load(spark, base, part, schema, name, fmt)
    assert load("nodes", "id string, n int").count() == 0
    assert snapshots.metadata_of(spark, base, "one", fmt) == {}
    snapshots.snapshot_save(base, nodes, edges, {"title": "t", "hidden": ["a"]}, "one", fmt)
    snapshots.snapshot_save(base, nodes.where("id = 'a'"), edges, {"title": "u", "hidden": []}, "one", fmt)
    assert [tuple(r) for r in load("nodes", "id string, n int").collect()] == [("a", 1)]
    assert [tuple(r) for r in load("edges", "source string, target string").collect()] == [("a", "b")]
    assert snapshots.metadata_of(spark, base, "one", fmt) == {"title": "u", "hidden": []}
    # Load, change, save under the same name.
    changed = load("nodes", "id string, n int").withColumn("n", F.lit(7))
    snapshots.snapshot_save(base, changed, load("edges", "source string, target string"), {}, "one", fmt)
    assert [tuple(r) for r in load("nodes", "id string, n int").collect()] == [("a", 7)]
    # A save that fails half way leaves the old version.
    broken = edges.withColumn("bad", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        snapshots.snapshot_save(base, nodes, broken, {}, "one", fmt)
    assert [tuple(r) for r in load("nodes", "id string, n int").collect()] == [("a", 7)]
    with pytest.raises(ValueError):
        snapshots.snapshot_save(base, nodes, edges, {}, "../up")


def test_saved_snapshots_are_listed(spark, tmp_path):
    base = str(tmp_path / "graphs")
    look = lambda: {r["name"]: (r["version"], r["recent"]) for r in snapshots.snapshot_list(spark, base).selectExpr("*", "saved > now() - INTERVAL 1 HOUR recent").collect()}
    assert look() == {}
    frame = spark.range(1)
    for name in ("one", "two parts", "one"):
        snapshots.snapshot_save(base, frame, frame, {}, name)
    with pytest.raises(Exception, match="stop"):
        snapshots.snapshot_save(base, frame.select(F.raise_error(F.lit("stop"))), frame, {}, "never")
    (tmp_path / "graphs" / "stray.txt").write_text("x")
    assert look() == {"one": (2, True), "two parts": (1, True)}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    assert versions.current(spark, path) is None
    for i in range(3):
        tables.create_table(spark.range(i, i + 1), path, replace=True)
    assert len(versions.versions(spark, path)) == 3
    versions.drop_old(spark, path)
    assert len(versions.versions(spark, path)) == 1 and tables.read_table(spark, path).first()["id"] == 2
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none"))


def test_create_table(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(3)
    assert tables.create_table(old, path).count() == 3
    with pytest.raises(FileExistsError):
        tables.create_table(old, path)
    assert [r["id"] for r in tables.create_table(spark.range(5, 6), path, replace=True).collect()] == [5]
    own = tables.read_table(spark, path).withColumn("id", F.col("id") + 1)
    assert [r["id"] for r in tables.create_table(own, path, replace=True).collect()] == [6]
    with pytest.raises(Exception, match="stop"):
        tables.create_table(own.select(F.raise_error(F.lit("stop")).alias("id")), path, replace=True)
    assert [r["id"] for r in tables.read_table(spark, path).collect()] == [6]


def test_create_view(spark):
    tables.create_view(spark.range(2), "lineloom_view", replace=True)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        tables.create_view(spark.range(2), "lineloom_view")
    assert tables.create_view(spark.range(4), "lineloom_view", replace=True).count() == 4
    spark.catalog.dropTempView("lineloom_view")


def test_partitioned_write_prunes(spark, tmp_path):
    df = spark.range(900).withColumn("day", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 10).cast("int"))
    stored = tables.write_partitioned(df, str(tmp_path / "p"), "day")
    assert stored.count() == 900
    one = stored.where("day = 4")
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == df.where("day = 4").count()


def test_scratch_lives_in_the_shared_folder_and_can_be_cleared(spark):
    from lineloom import session

    stored, seen = session.materialize(spark.range(4), "probe", n=F.count(F.lit(1)))
    assert seen == {"n": 4} and stored.count() == 4
    path = session.scratch_root(spark)
    assert path.startswith(session.shared_dir(spark)) and tables.path_exists(spark, path)
    session.clear_scratch(spark)
    assert not tables.path_exists(spark, path)


def test_days_are_replaced_all_at_once(spark, tmp_path):
    path = str(tmp_path / "days")
    make = lambda rows: spark.createDataFrame(rows, "id long, day date")
    d = [datetime.date(2024, 1, k) for k in range(1, 5)]
    first = tables.write_partitioned(make([(1, d[0]), (2, d[1]), (3, None)]), path, "day")
    look = lambda df: sorted((r["id"], r["day"]) for r in df.collect())
    key = lambda rows: sorted(rows, key=lambda r: r[0])
    assert look(first) == [(1, d[0]), (2, d[1]), (3, None)] and first.columns == ["id", "day"]
    for _ in range(2):
        second = tables.replace_partitions(make([(20, d[1]), (21, d[1]), (30, d[2])]), path, "day")
    assert look(second) == key([(1, d[0]), (20, d[1]), (21, d[1]), (30, d[2]), (3, None)])
    assert look(first) == [(1, d[0]), (2, d[1]), (3, None)], "a reader keeps what it saw"
    # A write that reads what it replaces, and one that fails.
    third = tables.replace_partitions(second.where("day = '2024-01-02'").selectExpr("id + 1 id", "day"), path, "day")
    assert look(third) == key([(1, d[0]), (21, d[1]), (22, d[1]), (30, d[2]), (3, None)])
    with pytest.raises(Exception):
        tables.replace_partitions(make([(9, d[0])]).selectExpr("id div 0 id", "day"), path, "day")
    again = tables.read_partitioned(spark, path, third.schema)
    assert look(again) == look(third)
    assert "PartitionFilters: [isnotnull(day" in compare.plan_of(again.where("day = '2024-01-03'"))
    tables.drop_unused(spark, path)
    assert look(tables.read_partitioned(spark, path, third.schema)) == look(third)
    fourth = tables.write_partitioned(make([]), path, "day")
    assert look(fourth) == [] and look(tables.read_partitioned(spark, str(tmp_path / "none"), third.schema)) == []

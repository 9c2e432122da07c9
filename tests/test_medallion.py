"""Medallion operators on small fixtures with hot keys and nulls, against DuckDB."""

import datetime

import duckdb
import pandas as pd
import pytest

import compare
from lineloom.operators.medallion import bronze, gold, silver


def _check(df, sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    assert compare.difference(compare.spark_rows(df), compare.duck_rows(con, sql)) is None


@pytest.mark.parametrize("grain", ["hour", "day", "year"])
def test_funnel_with_a_hot_user_and_long_sessions(spark, grain):
    t0 = datetime.datetime(2024, 1, 1)
    hours = lambda h: t0 + datetime.timedelta(hours=h)
    sessions = [(1, "a", hours(0), hours(60)), (1, "b", hours(10), hours(12)), (2, "c", hours(5), hours(5)), (3, "d", hours(1), hours(2)), (3, "d", hours(30), hours(31))]
    # A session of ten years, one inside it, one that ends before it starts, and rows with nulls.
    sessions += [(5, "e", hours(0), hours(87_600)), (5, "f", hours(50), hours(51)), (6, "g", hours(9), hours(8)), (7, "h", None, hours(3)), (7, "i", hours(1), None), (None, "j", hours(0), hours(9))]
    orders = [(1, i % 150, hours(i / 4)) for i in range(300)]
    orders += [(2, 900, hours(5)), (2, 901, hours(6)), (4, 902, hours(1)), (3, 903, hours(30.5)), (3, 904, hours(20))]
    orders += [(5, 910, hours(87_600)), (5, 911, hours(87_600.01)), (5, 912, hours(40_000)), (6, 913, hours(8.5)), (7, 914, hours(2)), (None, 915, hours(1)), (3, 916, hours(31))]
    s = pd.DataFrame(sessions, columns=["user_id", "session_id", "session_start", "session_end"])
    o = pd.DataFrame(orders, columns=["user_id", "order_id", "order_timestamp"])
    got = gold.conversion_funnel(
        spark.createDataFrame(sessions, "user_id long, session_id string, session_start timestamp_ntz, session_end timestamp_ntz"),
        spark.createDataFrame(orders, "user_id long, order_id long, order_timestamp timestamp_ntz"),
        grain,
    )
    sql = """SELECT s.user_id, count(DISTINCT s.session_id) AS total_sessions, count(DISTINCT o.order_id) AS total_orders,
               coalesce(count(DISTINCT o.order_id) / nullif(count(DISTINCT s.session_id), 0), 0) AS conversion_rate
             FROM s LEFT JOIN o ON s.user_id = o.user_id AND o.order_timestamp BETWEEN s.session_start AND s.session_end
             GROUP BY 1"""
    _check(got, sql, s=s, o=o)


def test_ctr_keeps_the_fan_out(spark):
    c = pd.DataFrame({"campaign_id": [1, 2, 3, 4, 4]})
    i = pd.DataFrame({"campaign_id": [1] * 7 + [2, 2, 4, 9], "impression_id": list(range(9)) + [None, 5]})
    k = pd.DataFrame({"campaign_id": [1, 1, 3, 4, 4, 4], "click_id": [1, None, 3, 4, 5, 6]})
    schema = lambda x: f"campaign_id long, {x} double"
    got = gold.campaign_ctr(
        spark.createDataFrame(c),
        spark.createDataFrame(i, schema("impression_id")).replace(float("nan"), None),
        spark.createDataFrame(k, schema("click_id")).replace(float("nan"), None),
    )
    sql = """SELECT c.campaign_id, count(i.impression_id) AS impressions, count(k.click_id) AS clicks,
               count(k.click_id) / nullif(count(i.impression_id), 0) AS ctr
             FROM c LEFT JOIN i ON c.campaign_id = i.campaign_id LEFT JOIN k ON c.campaign_id = k.campaign_id
             GROUP BY 1"""
    _check(got, sql, c=c, i=i, k=k)


def test_product_performance_unpacks_arrays_of_any_length(spark):
    rows = [
        ('[{"product_id":"P-1","quantity":2,"price":1.25},{"product_id":"P-2","quantity":1,"price":3}]',), ("[]",), (None,),
        ('[{"product_id":"P-1","quantity":1.555,"price":10}]',), ('[{"product_id":"P-2","quantity":"two","price":3}]',), ("not json",),
    ]
    got = {r["product_id"]: (r["units_sold"], r["revenue"], r["unreadable"]) for r in gold.product_performance(spark.createDataFrame(rows, "items string")).collect()}
    assert got == {"P-1": (3.555, 18.05, 0), "P-2": (1.0, 3.0, 1), None: (None, None, 1)}


def test_items_are_parsed_once(spark):
    df = spark.createDataFrame([('[{"product_id":"P","quantity":1,"price":2}]',)], "items string")
    assert compare.plan_of(gold.product_performance(df)).count("parseJson") == 1


def test_odd_items(spark):
    rows = [("{}",), ("7",), ("null",), ('[7, null, {"product_id": "P", "quantity": null, "price": 1}]',), ('[{"quantity": 2, "price": "3"}]',)]
    got = {r["product_id"]: (r["units_sold"], r["revenue"], r["unreadable"]) for r in gold.product_performance(spark.createDataFrame(rows, "items string")).collect()}
    assert got == {None: (2.0, 6.0, 5), "P": (None, None, 1)}


def test_a_long_session_is_one_row(spark):
    """The sweep has no explode: its rows are the sessions, the orders and one carried end per slice."""
    s = spark.createDataFrame([], "user_id long, session_id string, session_start timestamp_ntz, session_end timestamp_ntz")
    o = spark.createDataFrame([], "user_id long, order_id long, order_timestamp timestamp_ntz")
    plan = gold.conversion_funnel(s, o)._jdf.queryExecution().analyzed().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_money_keeps_parts_of_a_cent(spark):
    rows = [(datetime.datetime(2024, 1, 1), 0.004)] * 5 + [(datetime.datetime(2024, 1, 2), 12345678901234567.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, a double")
    assert gold.monthly_revenue(df, "t", "a").first()["total_revenue"] == pytest.approx(12345678901234567.02)
    assert gold.monthly_revenue(df.where("a < 1"), "t", "a").first()["total_revenue"] == 0.02


def test_orders_cleaned_keeps_unmatched_and_drops_cancelled(spark):
    orders = spark.createDataFrame([("1", "u", None, 1.0, "OK"), ("2", "x", None, 2.0, "OK"), ("3", "u", None, 3.0, "NO"), ("4", "u", None, 4.0, None)], "order_id string, user_id string, order_date timestamp, total_amount double, status string")
    users = spark.createDataFrame([("u", "DE")], "user_id string, country string")
    got = {r["order_id"]: r["country"] for r in silver.orders_cleaned(orders, users, "NO").collect()}
    assert got == {"1": "DE", "2": None}


def test_typed_load(spark):
    raw = spark.createDataFrame([("7", "2024-01-02", '{"k": 1}'), (None, None, "not json")], "a string, b string, c string")
    df = bronze.typed_load(raw, {"id": ("a", "int"), "day": ("b", "date"), "doc": ("c", "json")})
    assert dict(df.dtypes) == {"id": "int", "day": "date", "doc": "variant"}
    assert [(r["id"], r["day"], r["doc"] is None) for r in df.collect()] == [(7, datetime.date(2024, 1, 2), False), (None, None, True)]


def test_rescued_load_keeps_rows_and_names_what_does_not_fit(spark):
    raw = spark.createDataFrame([("7", "2024-01-02", "{}"), ("x", "2024-13-02", "{"), (None, None, None), ("8", "never", "1")], "a string, b string, c string")
    declared = {"id": ("a", "int"), "day": ("b", "date"), "doc": ("c", "json")}
    df = bronze.typed_load(raw, declared, rescued="lost")
    assert dict(df.dtypes) == {"id": "int", "day": "date", "doc": "variant", "lost": "map<string,string>"}
    good, bad = bronze.quarantine(df, "lost")
    assert [(r["id"], r["day"]) for r in good.collect()] == [(7, datetime.date(2024, 1, 2)), (None, None)] and "lost" not in good.columns
    assert [r["lost"] for r in bad.collect()] == [{"id": "x", "day": "2024-13-02", "doc": "{"}, {"day": "never"}]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bronze.typed_load(raw, declared).select("id").collect()
    with pytest.raises(ValueError):
        bronze.typed_load(raw, declared, rescued="id")


def test_user_stats_does_not_count_null_keys(spark):
    df = spark.createDataFrame([("d1", 1), ("d1", None), ("d2", None)], "day string, id int")
    assert {r["day"]: r["total_users"] for r in gold.user_stats(df, "day", "id").collect()} == {"d1": 1, "d2": 0}

"""The medallion mart: bronze to gold as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.operators.medallion import bronze, gold, silver

# How the order table lands: name -> (source column, type).
ORDERS_RAW = {
    "order_id": ("o_orderkey", "string"),
    "user_id": ("o_custkey", "string"),
    "order_date": ("o_orderdate", "timestamp_ntz"),
    "total_amount": ("o_totalprice", "double"),
    "status": ("o_orderstatus", "string"),
}

USERS_RAW = {
    "user_id": ("c_custkey", "string"),
    "segment": ("c_mktsegment", "string"),
    "country": ("c_nationkey", "int"),
}

# Status that counts as cancelled, and as completed.
CANCELLED, COMPLETED = "F", "O"

# Country codes of the region rule.
HOME, EUROPE = 0, [1, 2, 3]


def orders_raw(orders: DataFrame) -> DataFrame:
    return bronze.typed_load(orders, ORDERS_RAW)


def users_raw(customer: DataFrame) -> DataFrame:
    return bronze.typed_load(customer, USERS_RAW)


def cleaned(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return silver.orders_cleaned(orders_raw(orders), users_raw(customer), CANCELLED)


def medallion_mart(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Daily revenue by region.  Both filters and the column pruning reach the scans."""
    region = silver.region_of(F.col("country"), HOME, EUROPE)
    by_region = cleaned(orders, customer).withColumn("country", region)
    return gold.daily_revenue(by_region, COMPLETED).withColumnRenamed("country", "region")

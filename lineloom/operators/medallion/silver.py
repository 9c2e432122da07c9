"""Silver: cleaned and conformed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(df: DataFrame, key: str, lowered: str, dated: str) -> DataFrame:
    """Lower-case one text column, cast one timestamp to a date, drop null texts."""
    return df.where(F.col(lowered).isNotNull()).select(
        F.col(key), F.lower(lowered).alias(lowered), F.to_date(dated).alias(dated)
    )


def orders_cleaned(orders: DataFrame, users: DataFrame, cancelled: str) -> DataFrame:
    """Orders that are not cancelled, with their user's country.

    ``orders(order_id, user_id, order_date, total_amount, status)`` and
    ``users(user_id, country)``, users unique.  The status filter reaches the
    scan; a user with very many orders is on the outer side, which adaptive
    execution splits.
    """
    kept = orders.where(F.col("status") != cancelled)
    return kept.join(users.select("user_id", "country"), "user_id", "left").select(
        "order_id",
        "user_id",
        F.col("order_date").cast("timestamp_ntz").alias("order_timestamp"),
        "total_amount",
        "status",
        "country",
    )


# The regions of the country rule.
HOME_REGION, EUROPE_REGION, OTHER_REGION = "North America", "Europe", "Rest of World"


def region_of(country: Column, home, europe: list) -> Column:
    """Region by a searched CASE on the country code."""
    return (
        F.when(country == home, HOME_REGION).when(country.isin(*europe), EUROPE_REGION).otherwise(OTHER_REGION)
    )


def sessions(logs: DataFrame) -> DataFrame:
    """First and last time and number of views per (user_id, session_id).

    ``logs(user_id, session_id, ts)``; partial aggregation collapses each
    session before the shuffle.
    """
    return logs.groupBy("user_id", "session_id").agg(
        F.min("ts").alias("session_start"),
        F.max("ts").alias("session_end"),
        F.count(F.lit(1)).alias("page_views"),
    )

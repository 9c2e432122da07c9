"""Gold: business aggregates.

Money is summed as DECIMAL, so results do not depend on the order of addition.  The decimal's scale is
wide, so amounts below a cent count as they are; only the finished sum is turned into a double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MONEY = "decimal(38,10)"


def _money_sum(amount: Column, money: str = MONEY) -> Column:
    return F.sum(amount.cast(money)).cast("double")


def user_stats(users: DataFrame, day: str, key: str) -> DataFrame:
    """Users per sign-up day; null keys are not counted."""
    return users.groupBy(day).agg(F.count(key).alias("total_users"))


def daily_revenue(orders: DataFrame, completed: str, money: str = MONEY) -> DataFrame:
    """Revenue and distinct orders per day and country of completed orders."""
    done = orders.where(F.col("status") == completed)
    return done.groupBy(F.to_date("order_timestamp").alias("order_date"), "country").agg(
        _money_sum(F.col("total_amount"), money).alias("revenue"),
        F.count_distinct("order_id").alias("total_orders"),
    )


def monthly_revenue(payments: DataFrame, ts: str, amount: str, money: str = MONEY) -> DataFrame:
    return payments.groupBy(F.date_trunc("month", ts).cast("date").alias("month")).agg(
        _money_sum(F.col(amount), money).alias("total_revenue")
    )


ITEM_NUMBER = "decimal(18,6)"


def product_performance(orders: DataFrame, items: str = "items", number: str = ITEM_NUMBER) -> DataFrame:
    """Units and revenue per product from a JSON array of items per order.

    Product ids are texts; cast them afterwards where they are numbers.  ``unreadable`` counts
    a product's items whose quantity or price can't be read as ``number``; a text that
    is no array of items counts once under a null product.  Each text is parsed once, into a VARIANT whose array is
    unpacked next to its own row, so nothing is shuffled before the partial aggregate on the product.
    """
    listed = F.try_variant_get(F.try_parse_json(items), "$", "array<variant>")
    # An empty array has no items; a text that can't be read is one bad item.
    every = F.coalesce(listed, F.array(F.lit(None).cast("variant")))
    rows = orders.where(F.col(items).isNotNull()).select(F.explode(every).alias("item"))
    read = lambda name, kind: F.try_variant_get("item", f"$.{name}", kind).alias(name)
    rows = rows.select(read("product_id", "string"), read("quantity", number), read("price", number))
    bad = F.col("quantity").isNull() | F.col("price").isNull()
    return rows.groupBy("product_id").agg(
        F.sum("quantity").cast("double").alias("units_sold"),
        F.sum(F.col("quantity") * F.col("price")).cast("double").alias("revenue"),
        F.count_if(bad).alias("unreadable"),
    )


def converted_orders(sessions: DataFrame, orders: DataFrame, grain: str = "day") -> DataFrame:
    """(user_id, order_id): orders made during at least one session of their user.

    A sweep instead of a join: a user's session starts and orders are sorted together, and an order is inside a session when the
    greatest end of all sessions begun so far is not before it.  A user's time is split into slices of ``grain``, each
    sorted by itself; a slice begins with the greatest end carried over from earlier ones, which is computed from
    one row per slice.  A session is one row however long it lasts, and a busy user is as many groups as slices.
    Null users, starts and order times match nothing.
    """
    time = sessions.schema["session_start"].dataType
    opened = sessions.select(
        "user_id", F.col("session_start").alias("at"), F.lit(0).alias("kind"), F.col("session_end").alias("until"), F.lit(None).cast(orders.schema["order_id"].dataType).alias("order_id")
    )
    placed = orders.select("user_id", F.col("order_timestamp").cast(time).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(time).alias("until"), "order_id")
    marks = opened.unionByName(placed).where("user_id IS NOT NULL AND at IS NOT NULL")
    marks = marks.withColumn("slice", F.date_trunc(grain, "at").cast(time))
    earlier = W.partitionBy("user_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = marks.groupBy("user_id", "slice").agg(F.max("until").alias("until"))
    carried = slices.select(
        "user_id", F.lit(None).cast(time).alias("at"), F.lit(-1).alias("kind"), F.max("until").over(earlier).alias("until"), F.lit(None).cast(orders.schema["order_id"].dataType).alias("order_id"), "slice"
    )
    # The carried end has no time and so sorts first; a session that starts with an order comes before it.
    sweep = W.partitionBy("user_id", "slice").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    swept = marks.unionByName(carried.where("until IS NOT NULL")).withColumn("covered", F.max("until").over(sweep))
    return swept.where("kind = 1 AND at <= covered").select("user_id", "order_id")


def conversion_funnel(sessions: DataFrame, orders: DataFrame, grain: str = "day") -> DataFrame:
    """Sessions, orders made during a session, and their ratio per user.

    ``sessions(user_id, session_id, session_start, session_end)`` and
    ``orders(user_id, order_id, order_timestamp)``.  Counting distinct orders
    over the left interval join equals counting the orders that fall in at
    least one session, so no pairs are made: see ``converted_orders``.
    """
    converted = converted_orders(sessions, orders, grain).groupBy("user_id").agg(F.count_distinct("order_id").alias("n_orders"))
    per_user = sessions.groupBy("user_id").agg(F.count_distinct("session_id").alias("total_sessions"))
    total = F.coalesce("n_orders", F.lit(0))
    return per_user.join(converted, "user_id", "left").select(
        "user_id",
        "total_sessions",
        total.alias("total_orders"),
        F.coalesce(total / F.nullif("total_sessions", F.lit(0)), F.lit(0.0)).alias("conversion_rate"),
    )


def campaign_ctr(campaigns: DataFrame, impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Impressions, clicks and their ratio per campaign over two left joins.

    All inputs have ``campaign_id``; ``impression_id`` and ``click_id`` are
    counted when not null.  The two joins fan out against each other, which the
    counts keep: each side is counted per campaign first and the counts are
    multiplied, so the product is computed but its rows are never made.
    """
    seen = impressions.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("i_rows"), F.count("impression_id").alias("i_ids")
    )
    hit = clicks.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("c_rows"), F.count("click_id").alias("c_ids")
    )
    base = campaigns.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("rows"))
    joined = base.join(seen, "campaign_id", "left").join(hit, "campaign_id", "left")
    one, none = F.lit(1), F.lit(0)
    shown = F.col("rows") * F.coalesce("i_ids", none) * F.coalesce("c_rows", one)
    clicked = F.col("rows") * F.coalesce("c_ids", none) * F.coalesce("i_rows", one)
    return joined.select(
        "campaign_id",
        shown.alias("impressions"),
        clicked.alias("clicks"),
        (clicked / F.nullif(shown, none)).alias("ctr"),
    )


def delayed(shipments: DataFrame, status: str, value: str, columns: list[str]) -> DataFrame:
    """Shipments in one state; filter and projection reach the scan."""
    return shipments.where(F.col(status) == value).select(*columns)

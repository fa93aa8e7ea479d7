"""Business queries over orders, customers and events, built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import epoch_ms

#: First match wins.
RISK_RULES = (
    ("LARGE_AMOUNT", lambda amount, hour, merchant: amount > 400_000),
    ("ODD_HOUR", lambda amount, hour, merchant: hour.between(2, 5)),
    ("SUSPICIOUS_MERCHANT", lambda amount, hour, merchant: merchant.contains("URGENT")),
)


def gmv(orders: DataFrame) -> DataFrame:
    return orders.agg(F.round(F.sum("o_totalprice"), 2).alias("gmv"), F.count(F.lit(1)).alias("order_count"))


def ranking(df: DataFrame, by: str, columns: list, order: str, n: int) -> DataFrame:
    """The n groups with the largest `order`; ties by the group."""
    return df.groupBy(by).agg(*columns).orderBy(F.col(order).desc(), by).limit(n)


def large(df: DataFrame, amount: str, least: float) -> DataFrame:
    """Number of transactions of `least` or more and the sum of their whole amounts."""
    return df.where(F.col(amount) >= least).agg(F.count(F.lit(1)).alias("cnt"), F.coalesce(F.sum(F.floor(F.col(amount)).cast("bigint")), F.lit(0).cast("bigint")).alias("total"))


def frequent_users(df: DataFrame, user: str, ms: str, below: int) -> DataFrame:
    """Users with two rows or more whose integer mean gap between rows is below a bound: the gaps telescope, so no ordering is needed."""
    by = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.min(ms).alias("_lo"), F.max(ms).alias("_hi")).where("n >= 2")
    return by.withColumn("mean_gap", F.expr("(_hi - _lo) div (n - 1)")).where(F.col("mean_gap") < below).select(user, "n", "mean_gap")


def unusual_places(events: DataFrame, history: DataFrame, user: str, place: str) -> DataFrame:
    """Rows whose (user, place) is not in the history."""
    return events.join(history.select(user, place).distinct(), [user, place], "left_anti")


def risk(df: DataFrame, amount: str, ts: str, merchant: str) -> DataFrame:
    """df with the name of the first rule that matches, and only rows that match one."""
    out = None
    for name, rule in RISK_RULES:
        cond = rule(F.col(amount), F.hour(ts), F.col(merchant))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return df.withColumn("rule", out).where(F.col("rule").isNotNull())


def bursts(df: DataFrame, user: str, ms: str, reach: int, more_than: int) -> DataFrame:
    """Rows with more than so many rows of their user in the trailing (ms - reach, ms]."""
    w = Window.partitionBy(user).orderBy(ms).rangeBetween(-(reach - 1), 0)
    return df.withColumn("recent", F.count(F.lit(1)).over(w)).where(F.col("recent") > more_than)


def parsed_orders(events: DataFrame) -> DataFrame:
    """Orders from JSON rows: k of props is the amount; invalid ones (no user, no positive amount) go."""
    body = F.from_json("props", "k bigint")
    out = events.select("event_id", "user_id", epoch_ms("ts").alias("ms"), body["k"].alias("amount"))
    return out.where(F.col("user_id").isNotNull() & (F.col("amount") > 0))

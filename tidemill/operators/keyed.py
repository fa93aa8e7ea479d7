"""Keyed state without windows: the aggregate so far for every row, with optional time to live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import Accumulator, Aggregate
from .ordered import BLOCK, JOINS, Run, running_all

PIECE = 8192  # rows of a piece of a group


def so_far(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_aggregate(df: DataFrame, keys: list[str], order: list[str], aggregate: Aggregate, value: Column, into: str, block: int | None = BLOCK) -> DataFrame:
    """df with the key's aggregate up to and including each row, in arrival order. Null keys form a key of their own.

    An aggregate whose results combine runs in blocks of a key (ranges of the first order column, a number), so a hot key is no single task;
    others, and all with block=None, run as one window a key.
    """
    if block is None or not aggregate.combines:
        return df.withColumn(into, aggregate.over(value, so_far(keys, order)))
    runs = {f"_part{i}": Run(total, value, JOINS[total], rows=build) for i, (build, total) in enumerate(aggregate.parts)}
    return running_all(df, order, runs, keys, block=block).withColumn(into, aggregate.finish(*map(F.col, runs))).drop(*runs)


def running_reduce(df: DataFrame, keys: list[str], order: list[str], value: Column, into: str, add: Callable[[Column, Column], Column] | None = None, builtin: Callable[[Column], Column] | None = None, block: int = BLOCK) -> DataFrame:
    """df with the key's reduction so far. builtin (F.max, F.min, F.sum) runs in blocks of a key; any other add folds what came so far, row by row: it costs the square of a key's rows."""
    if builtin in JOINS:
        return running_all(df, order, {into: Run(builtin, value, JOINS[builtin])}, keys, block=block)
    if builtin:
        return df.withColumn(into, builtin(value).over(so_far(keys, order)))
    values = F.collect_list(value).over(so_far(keys, order))
    return df.withColumn("_seen", values).withColumn(into, F.aggregate(F.slice("_seen", 2, F.greatest(F.size("_seen") - 1, F.lit(0))), F.get("_seen", F.lit(0)), add)).drop("_seen")


def totals(df: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """The final aggregate of each key."""
    return df.groupBy(*keys).agg(*columns)


def combined(df: DataFrame, keys: list[str], accumulator: Accumulator, value: Column, into: str, piece: int = PIECE) -> DataFrame:
    """The final result of a user's aggregate for each key, with partial results: pieces of a group of at most `piece` rows are folded where they lie, and their accumulators merged."""
    rows = df.select(*keys, value.alias("_v"), F.spark_partition_id().alias("_p"), F.floor(F.monotonically_increasing_id() / piece).alias("_i"))
    parts = rows.groupBy(*keys, "_p", "_i").agg(accumulator.fold(F.collect_list("_v")).alias("_a"))
    return parts.groupBy(*keys).agg(accumulator.result(accumulator.combine(F.collect_list("_a"))).alias(into))


def lives(df: DataFrame, keys: list[str], ttl: int, into: str = "_life", rn: str = "rn", ms: str = "ms") -> DataFrame:
    """df with the number of the state's life that a row belongs to, for state that a watermark drops once it exceeds the key's last arrival by more than ttl.

    df needs rn, ms and the columns of watermarks.replay. The state is gone before row j if the watermark before j exceeds that limit and some watermark was sent at or
    after the key's previous row, that is if it has moved since before that row.
    """
    own = Window.partitionBy(*keys).orderBy(rn)
    before = F.lag("previous_wm").over(own)
    gone = (F.col("previous_wm") > F.lag(ms).over(own) + ttl) & (before.isNull() | (F.col("previous_wm") > before))
    df = df.withColumn("_break", F.coalesce(gone, F.lit(False)).cast("int"))
    return df.withColumn(into, F.sum("_break").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def running_with_ttl(df: DataFrame, keys: list[str], ttl: int, aggregate: Aggregate, value: Column, into: str, rn: str = "rn", ms: str = "ms", block: int = BLOCK) -> DataFrame:
    """Running aggregate whose state lives as lives() says; 0 never drops."""
    if not ttl:
        return running_aggregate(df, keys, [rn], aggregate, value, into, block)
    return running_aggregate(lives(df, keys, ttl, "_life", rn, ms), [*keys, "_life"], [rn], aggregate, value, into, None).drop("_life")


def reduce_with_ttl(df: DataFrame, keys: list[str], ttl: int, value: Column, into: str, add: Callable | None = None, builtin: Callable | None = None, rn: str = "rn", ms: str = "ms") -> DataFrame:
    """Running reduction whose state lives as lives() says."""
    alive = lives(df, keys, ttl, "_life", rn, ms)
    if builtin:
        return alive.withColumn(into, builtin(value).over(so_far([*keys, "_life"], [rn]))).drop("_life")
    return running_reduce(alive, [*keys, "_life"], [rn], value, into, add).drop("_life")

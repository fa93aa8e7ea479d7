"""Watermarks as columns: the batch replay of what a stream would have seen, row by row, in arrival order."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import BLOCK, Run, count_rows, next_min, running_all, running_max

VALUES = 1 << 20  # milliseconds of watermarks in a block


@dataclass(frozen=True)
class WatermarkStrategy:
    """When a row happened (ms since the epoch) and which watermark it carries: a null carries none; watermarks never fall."""

    time: Column
    mark: Column

    @staticmethod
    def bounded(time: Column, delay: int) -> WatermarkStrategy:
        """The largest time so far minus delay."""
        return WatermarkStrategy(time, time - delay)

    @staticmethod
    def ascending(time: Column) -> WatermarkStrategy:
        return WatermarkStrategy(time, time)

    @staticmethod
    def punctuated(time: Column, carries: Column, delay: int = 0) -> WatermarkStrategy:
        """Only rows for which `carries` holds send a watermark."""
        return WatermarkStrategy(time, F.when(carries, time - delay))


def _marked(out: DataFrame) -> DataFrame:
    """wm, previous_wm and emits, from the running watermark with and without the row."""
    return out.withColumn("emits", F.col("wm").isNotNull() & (F.col("previous_wm").isNull() | (F.col("wm") > F.col("previous_wm"))))


def _runs(mark: Column) -> dict[str, Run]:
    return {"wm": Run(F.max, mark, F.greatest), "previous_wm": Run(F.max, mark, F.greatest, before=True)}


def replay(df: DataFrame, order: list[str], strategy: WatermarkStrategy, block: int = BLOCK) -> DataFrame:
    """df with ms, rn (arrival number from 1), wm (the watermark after the row), previous_wm (before it, null at first) and emits (whether the row moved it), in one pass."""
    df = df.withColumn("ms", strategy.time)
    return _marked(running_all(df, order, {"rn": count_rows(), **_runs(strategy.mark)}, block=block))


def bounded_out_of_orderness(df: DataFrame, rn: str = "rn", ms: str = "ms", delay: int = 0, block: int = BLOCK) -> DataFrame:
    """df, which has an arrival number, with wm (largest time so far minus delay), previous_wm (null at first) and emits (whether the row moved it)."""
    return _marked(running_all(df, [rn], _runs(F.col(ms) - delay), block=block))


def ascending(df: DataFrame, rn: str = "rn", ms: str = "ms", block: int = BLOCK) -> DataFrame:
    return bounded_out_of_orderness(df, rn, ms, 0, block)


def trace(df: DataFrame, interval: int = 1, rn: str = "rn") -> DataFrame:
    """rn and wm of the watermarks that are sent: those that moved; with an interval over 1 ms, only wm >= last sent + interval, and the last.

    Each such choice depends on the one before, so that case is one sequential pass in one task, over the moved watermarks only.
    """
    moved = df.where("emits").select(rn, "wm")
    if interval <= 1:
        return moved

    def greedy(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by(rn)
        values, keep = table["wm"].to_pylist(), []
        for i, wm in enumerate(values):
            if not keep or wm >= values[keep[-1]] + interval:
                keep.append(i)
        if values and values[-1] > values[keep[-1]]:
            keep.append(len(values) - 1)
        return table.take(pa.array(keep, pa.int64())).select([rn, "wm"])

    return moved.groupBy(F.lit("all")).applyInArrow(greedy, moved.schema)


def late(df: DataFrame) -> Column:
    """Whether the row's time is below the watermark it met."""
    return F.coalesce(F.col("ms") < F.col("previous_wm"), F.lit(False))


def late_counts(df: DataFrame, lateness: int = 0) -> DataFrame:
    """One row: records, late (below the watermark they met) and dropped (by more than lateness)."""
    behind = F.col("previous_wm") - F.col("ms")
    return df.agg(F.count(F.lit(1)).alias("records"), F.count_if(behind > 0).alias("late"), F.count_if(behind > lateness).alias("dropped"))


def last(df: DataFrame, delay: int = 0, ms: str = "ms") -> Column:
    """The last watermark, as a scalar subquery: it is computed when the plan runs; null without rows."""
    return df.agg(F.max(ms)).scalar() - delay


def closed(df: DataFrame, end: str, delay: int = 0, ms: str = "ms") -> Column:
    """A condition on window ends: the last watermark reached the window's last millisecond."""
    return F.col(end) - 1 <= last(df, delay, ms)


def panes(df: DataFrame, rn: str = "rn", end: str = "window_end", block: int = VALUES) -> DataFrame:
    """df (rows assigned to windows, with wm, previous_wm and emits) with pane: the arrival number of the watermark that fires the row's result.

    A row's result is fired by the first watermark from its arrival on that reaches its window's last millisecond. Before that window fired this is the first that is
    large enough; afterwards (the row opens a fresh pane) it is the next that moves, which is the first above the one that the row met. So
    each row asks for the first watermark of at least max(end - 1, previous + 1), and takes the next one on a line of questions and watermarks by
    value, in blocks of `block` ms: no join by inequality. Rows that nothing fires are left out.
    """
    row = F.struct(*df.columns)
    asks = F.struct(F.greatest(F.col(end) - 1, F.col("previous_wm") + 1).alias("at"), F.lit(0).alias("tie"), F.lit(None).cast("bigint").alias("sent"), row.alias("row"))
    sends = F.struct(F.col("wm").alias("at"), F.lit(1).alias("tie"), F.col(rn).cast("bigint").alias("sent"), F.lit(None).cast(df.schema).alias("row"))
    line = df.select(F.explode(F.when(F.col("emits"), F.array(asks, sends)).otherwise(F.array(asks))).alias("x")).select("x.*")
    found = next_min(line, ["at", "tie"], F.col("sent"), "pane", block)
    return found.where("tie = 0 AND pane IS NOT NULL").select("row.*", "pane")


def partitioned_min(df: DataFrame, partition: str, partitions: list, rn: str = "rn", ms: str = "ms", delay: int = 0, block: int = BLOCK, idle: int | None = None, clock: str | None = None) -> DataFrame:
    """df with global_wm: the smallest of the partitions' own watermarks, null until each has one; it never falls. The partitions are a given, short list.

    idle: a partition whose watermark has not moved for more than so many ms of the column `clock` (arrival time) is left out until it moves again; while all are idle
    the watermark stays. A partition that never had a row counts from the first row's clock.
    """
    mine = [F.col(partition).eqNullSafe(F.lit(p)) for p in partitions]
    at = [F.when(m, F.col(ms)) for m in mine]
    n = range(len(partitions))
    runs = {f"_p{i}": Run(F.max, at[i], F.greatest) for i in n}
    if idle is not None:
        runs |= {f"_q{i}": Run(F.max, at[i], F.greatest, before=True) for i in n}
    out = running_all(df, [rn], runs, block=block)
    known, least = F.lit(True), F.lit(None).cast("bigint")
    if idle is None:
        for i in n:
            known, least = known & F.col(f"_p{i}").isNotNull(), F.least(least, F.col(f"_p{i}"))
        return out.withColumn("global_wm", F.when(known, least - delay)).drop(*runs)
    moves = [F.when(mine[i] & (F.col(f"_q{i}").isNull() | (F.col(ms) > F.col(f"_q{i}"))), F.col(clock)) for i in n]
    out = running_all(out, [rn], {f"_m{i}": Run(F.max, moves[i], F.greatest) for i in n} | {"_began": Run(F.min, F.col(clock), F.least)}, block=block)
    for i in n:
        active = F.col(clock) - F.coalesce(F.col(f"_m{i}"), F.col("_began")) <= idle
        known = known & (~active | F.col(f"_p{i}").isNotNull())
        least = F.least(least, F.when(active, F.col(f"_p{i}")))
    out = out.withColumn("_now", F.when(known, least - delay))
    return running_max(out, [rn], F.col("_now"), "global_wm", block).drop(*runs, *[f"_m{i}" for i in n], "_began", "_now")


def partition_status(df: DataFrame, partition: str, ms: str = "ms", clock: str = "clock", delay: int = 0, idle: int = 60_000) -> DataFrame:
    """One row a partition: its watermark, the clock at which it last moved, and whether it is idle at the last row's clock."""
    by = df.groupBy(partition).agg((F.max(ms) - delay).alias("watermark"), F.min_by(clock, F.struct(-F.col(ms), F.col(clock))).alias("moved_at"))
    return by.withColumn("idle", df.agg(F.max(clock)).scalar() - F.col("moved_at") > idle)

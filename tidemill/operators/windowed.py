"""Event-time and count windows over batches, with the emission rules of a stream.

Only windows that a watermark closes are emitted (emit='closed'); emit='all' also flushes the open ones. Aggregates combine
before the shuffle; fold and apply gather the rows of a window, ordered by arrival.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.triggers import Trigger, firings
from ..functions.windows import Count, Global, Session
from . import watermarks
from .ordered import BLOCK, numbered

FOREVER = 1 << 62  # the end of the global window


def assign(df: DataFrame, assigner, ms: str = "ms", keys: list[str] = ()) -> DataFrame:
    """A row for each window of each row, with window_start and window_end; rows in no window go. Merging sessions are those of the key."""
    if isinstance(assigner, Session) and assigner.merge:
        return sessions(df, assigner.gap, list(keys), ms)
    if isinstance(assigner, Global):
        return df.withColumn("window_start", F.lit(-FOREVER)).withColumn("window_end", F.lit(FOREVER))
    return df.withColumn("window_start", F.explode(assigner.starts(F.col(ms)))).withColumn("window_end", F.col("window_start") + assigner.size)


def sessions(df: DataFrame, gap: int, keys: list[str], ms: str = "ms") -> DataFrame:
    """df with window_start and window_end of its merged session: islands of rows of a key at most `gap` apart. A key's rows are ordered in one task."""
    w = Window.partitionBy(*keys).orderBy(ms)
    marked = df.withColumn("_new", (F.col(ms) - F.lag(ms).over(w) > gap).cast("int"))
    island = F.sum(F.coalesce(F.col("_new"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_island", island)
    whole = Window.partitionBy(*keys, "_island")
    return marked.withColumn("window_start", F.min(ms).over(whole)).withColumn("window_end", F.max(ms).over(whole) + gap).drop("_new", "_island")


def aggregate(df: DataFrame, assigner, keys: list[str], columns: list[Column], emit: str = "closed", delay: int = 0, ms: str = "ms") -> DataFrame:
    """One row for each key and window: keys, window_start, window_end and the aggregate columns."""
    if isinstance(assigner, Session) and assigner.merge:
        # Spark's own session windows merge in the aggregation, with partial results; the time column is rebuilt from milliseconds
        own = F.session_window(F.timestamp_millis(F.col(ms)), f"{assigner.gap} milliseconds")
        # bounds as aggregates: a later condition on them must not reach the rows before they are merged
        out = df.groupBy(*keys, own.alias("_w")).agg(F.min(ms).alias("window_start"), (F.max(ms) + assigner.gap).alias("window_end"), *columns).drop("_w")
    else:
        out = assign(df, assigner, ms).groupBy(*keys, "window_start", "window_end").agg(*columns)
    return out.where(watermarks.closed(df, "window_end", delay, ms)) if emit == "closed" else out


def triggered(df: DataFrame, assigner, keys: list[str], trigger: Trigger, delay: int = 0, rn: str = "rn", ms: str = "ms", flush: bool = False) -> DataFrame:
    """A row for each firing that a row is part of, with window_start, window_end and firing (numbered from 0 in its window): aggregate by those.

    df needs the columns of watermarks.replay. The trigger sees the rows of a key's window one after another, so those meet in one task; only its decisions are made
    there, aggregates of a firing are Spark's.
    """
    rows = assign(df, assigner, ms, keys).withColumn("_last", watermarks.last(df, delay, ms))
    schema = T.StructType([*rows.schema.fields, T.StructField("_firings", T.ArrayType(T.LongType()))])

    def decide(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by(rn)
        now = table[trigger.clock].to_pylist() if trigger.clock else [None] * len(table)
        seen = list(zip(table[ms].to_pylist(), table["previous_wm"].to_pylist(), now, strict=True))
        out = firings(trigger, seen, table["window_end"][0].as_py(), table["_last"][0].as_py(), flush)
        return table.append_column("_firings", pa.array(out, pa.list_(pa.int64())))

    decided = rows.groupBy(*keys, "window_start", "window_end").applyInArrow(decide, schema)
    return decided.withColumn("firing", F.explode("_firings")).drop("_firings", "_last")


def gathered(value: Column, order: Column) -> Column:
    """The values of a group in arrival order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def fold(zero: Column, add: Callable[[Column, Column], Column], value: Column, order: Column) -> Column:
    """A left fold over the values of a group in arrival order, each once."""
    return F.aggregate(gathered(value, order), zero, add)


def reduce(add: Callable[[Column, Column], Column], value: Column, order: Column) -> Column:
    """A binary reduction in arrival order, the first value as it is. For max, min and sums use the aggregates: they combine early."""
    values = gathered(value, order)
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), add)


def counted(df: DataFrame, count: Count, keys: list[str], order: list[str], columns: list[Column]) -> DataFrame:
    """Windows of count.size rows by arrival, per key; only complete ones fire. `n` numbers a key's windows from 0."""
    slide = count.slide or count.size
    # numbered in blocks of a key: a hot key is no single task
    rows = numbered(df, order, "_rn", BLOCK, keys).withColumn("_rn", F.col("_rn") - 1)
    last = F.floor(F.col("_rn") / slide)
    first = F.greatest(F.ceil((F.col("_rn") - count.size + 1) / slide), F.lit(0))
    rows = rows.withColumn("n", F.explode(F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))))
    return rows.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("_rows"), *columns).where(F.col("_rows") == count.size).drop("_rows")


def early(df: DataFrame, assigner, keys: list[str], value: Column, total: Callable[[Column], Column], order: list[str], ms: str = "ms", into: str = "result") -> DataFrame:
    """The early results of the event-time trigger: a row in the last millisecond of its window fires what the window has so far."""
    rows = assign(df, assigner, ms)
    w = Window.partitionBy(*keys, "window_start", "window_end").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, total(value).over(w)).where(F.col(ms) >= F.col("window_end") - 1)


def split_late(df: DataFrame, lateness: int = 0) -> tuple[DataFrame, DataFrame]:
    """(on time, late): the side output holds rows whose time is more than lateness below the watermark they met."""
    gone = F.coalesce(F.col("ms") < F.col("previous_wm") - lateness, F.lit(False))
    return df.where(~gone), df.where(gone)

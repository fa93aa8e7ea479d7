"""Running values over a global order, or over each key's, without bringing all rows to one task.

Rows are blocked by ranges of the first order column. Each block (of a key) is one row of a small table over which totals run; within a block an ordinary window
runs. A block is bounded by its range, and the small table by the number of blocks. All values that are wanted come from one pass: one aggregate, one join.
Rows whose first order column is null come first (backward: last), in a block of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20
Total = Callable[[Column], Column]
Join = Callable[[Column, Column], Column]


def plus(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


@dataclass(frozen=True)
class Run:
    """total (an aggregate: F.max, F.min, F.sum ...) of a value over all rows up to each row; join combines two totals, nulls allowed. before: without the row itself.
    rows: the aggregate that rows go through first, where that is not total itself (a count, whose results are summed)."""

    total: Total
    value: Column
    join: Join
    before: bool = False
    rows: Total | None = None

    def over_rows(self, value: Column) -> Column:
        return (self.rows or self.total)(value)


#: How two totals of an aggregate combine.
JOINS = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.min: F.least, F.max: F.greatest}


def count_rows() -> Run:
    return Run(F.sum, F.lit(1).cast("bigint"), plus)


def running_all(df: DataFrame, order: list[str], runs: dict[str, Run], keys: list[str] = (), backward: bool = False, block: int = BLOCK) -> DataFrame:
    """df with a column for each of runs, over all rows up to each row in the order (backward: from it on), within its key where keys are given."""
    # an order column that is dense (row numbers, event ids, milliseconds) gives blocks of a bounded number of rows
    df = df.withColumn("_block", F.coalesce(F.floor(F.col(order[0]) / block), F.lit(-(1 << 63))))
    df = df.withColumns({f"_v_{name}": r.value for name, r in runs.items()})
    blocks = df.groupBy(*keys, "_block").agg(*[r.over_rows(F.col(f"_v_{name}")).alias(f"_t_{name}") for name, r in runs.items()])
    over = Window.partitionBy(*keys) if keys else Window
    around = over.orderBy(F.col("_block").desc() if backward else F.col("_block")).rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_k_{i}" for i, k in enumerate(keys)}
    blocks = blocks.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("_block").alias("_b"), *[r.total(F.col(f"_t_{name}")).over(around).alias(f"_a_{name}") for name, r in runs.items()])
    same = F.col("_block") == F.col("_b")
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    out = df.join(blocks, same)
    rows = [F.col(c).desc() if backward else F.col(c) for c in order]
    for name, r in runs.items():
        within = Window.partitionBy(*keys, "_block").orderBy(*rows).rowsBetween(Window.unboundedPreceding, -1 if r.before else 0)
        out = out.withColumn(name, r.join(F.col(f"_a_{name}"), r.over_rows(F.col(f"_v_{name}")).over(within)))
    return out.drop("_block", "_b", *names.values(), *[f"{p}{name}" for name in runs for p in ("_v_", "_a_")])


def running(df: DataFrame, order: list[str], total: Total, value: Column, into: str, join: Join, backward: bool = False, block: int = BLOCK) -> DataFrame:
    """df with `into`: total(value) over all rows up to this one (backward: from this one on) in the order."""
    return running_all(df, order, {into: Run(total, value, join)}, backward=backward, block=block)


def numbered(df: DataFrame, order: list[str], into: str = "rn", block: int = BLOCK, keys: list[str] = ()) -> DataFrame:
    """df with its row number in the order, from 1; within its key where keys are given."""
    return running_all(df, order, {into: count_rows()}, keys, block=block)


def running_max(df: DataFrame, order: list[str], value: Column, into: str, block: int = BLOCK) -> DataFrame:
    return running(df, order, F.max, value, into, F.greatest, block=block)


def next_min(df: DataFrame, order: list[str], value: Column, into: str, block: int = BLOCK) -> DataFrame:
    """The smallest value from this row on."""
    return running(df, order, F.min, value, into, F.least, backward=True, block=block)


def framed(df: DataFrame, number: str, rows: int, compute: Callable[[DataFrame, list], DataFrame], block: int = BLOCK, keys: list[str] = ()) -> DataFrame:
    """compute(df, partition columns) where each row needs at most `rows` rows before it, by a dense row number (of its key).

    Each block also gets the last rows of the block before it, as a halo, which leaves again after the computation.
    """
    block = max(block, rows + 1)
    at = F.col(number)
    own = F.floor(at / block)
    places = F.when(F.pmod(at, F.lit(block)) >= block - rows, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(places))
    return compute(spread, [*keys, "_block"]).where("_block = _own").drop("_block", "_own")

"""Aggregates as named column builders. Each works in groupBy().agg(), over() and streaming aggregation.

Sums and averages count a null as zero (and average counts the row), unless ignore_nulls asks for SQL's rule. An empty
group has sum 0, average 0.0, and no minimum or maximum.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


Build = Callable[[Column], Column]
Merge = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Aggregate:
    """A name, parts (each a builder from a value column to an aggregate column, and the aggregate that totals results of it, None if they do not combine), and finish,
    applied to the results of the parts."""

    name: str
    parts: tuple[tuple[Build, Build | None], ...]
    finish: Callable[..., Column] = lambda c: c

    def column(self, value: Column) -> Column:
        return self.finish(*[build(value) for build, _ in self.parts])

    def over(self, value: Column, window) -> Column:
        return self.finish(*[build(value).over(window) for build, _ in self.parts])

    @property
    def combines(self) -> bool:
        return all(total is not None for _, total in self.parts)


def _one(name: str, build: Build, total: Build | None, finish: Callable[..., Column] = lambda c: c) -> Aggregate:
    return Aggregate(name, ((build, total),), finish)


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _zeros(ignore_nulls: bool) -> Build:
    return lambda v: v.cast("double") if ignore_nulls else F.coalesce(v.cast("double"), F.lit(0.0))


def count() -> Aggregate:
    return _one("count", lambda v: F.count(F.lit(1)), F.sum)


def sum_long() -> Aggregate:
    return _one("sum", lambda v: F.sum(F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint"))), F.sum, lambda c: F.coalesce(c, F.lit(0).cast("bigint")))


sum_int = sum_long


def sum_double(ignore_nulls: bool = False) -> Aggregate:
    value = _zeros(ignore_nulls)
    return _one("sum", lambda v: F.sum(value(v)), F.sum, _or_zero)


def average(ignore_nulls: bool = False) -> Aggregate:
    value = _zeros(ignore_nulls)
    parts = ((lambda v: F.sum(value(v)), F.sum), (lambda v: F.count(value(v)), F.sum))
    return Aggregate("average", parts, lambda total, n: F.when(n > 0, total / n).otherwise(F.lit(0.0)))


def minimum() -> Aggregate:
    return _one("min", F.min, F.min)


def maximum() -> Aggregate:
    return _one("max", F.max, F.max)


def last_by(order: Column) -> Aggregate:
    """The value of the row with the greatest order."""
    return _one("last", lambda v: F.max_by(v, order), None)


def user_defined(name: str, zero: Column, add: Callable[[Column, Column], Column], result: Callable[[Column], Column] = lambda c: c, order: Column | None = None) -> Aggregate:
    """An aggregate from createAccumulator / add / getResult as a left fold over the group's values, in the given order.

    The group's values are gathered into one array: for functions that no built-in expresses. Prefer built-ins, which combine before the shuffle.
    """

    def build(v: Column) -> Column:
        if order is None:
            return F.collect_list(v)
        return F.array_sort(F.collect_list(F.struct(order.alias("o"), v.alias("v"))))

    def finish(c: Column) -> Column:
        values = c if order is None else F.transform(c, lambda x: x["v"])
        return F.aggregate(values, zero, add, result)

    return _one(name, build, None, finish)


@dataclass(frozen=True)
class Accumulator:
    """A user's aggregate that combines: zero, add (accumulator, value), merge (two accumulators), result. For keyed.combined(), which folds pieces of a group and merges those."""

    zero: Column
    add: Callable[[Column, Column], Column]
    merge: Merge
    result: Callable[[Column], Column] = lambda c: c

    def fold(self, values: Column) -> Column:
        """One accumulator from an array of values."""
        return F.aggregate(values, self.zero, self.add)

    def combine(self, accumulators: Column) -> Column:
        """One accumulator from an array of them, left to right; null for an empty one."""
        rest = F.slice(accumulators, 2, F.greatest(F.size(accumulators) - 1, F.lit(0)))
        return F.aggregate(rest, F.get(accumulators, F.lit(0)), self.merge)


def stats(value: Column, digits: int = 4) -> list[Column]:
    """sum, average, max, min and count of a value; the maximum is right for negative values too."""
    return [
        F.round(sum_double().column(value), digits).alias("sum_value"),
        F.round(average().column(value), digits).alias("avg_value"),
        F.max(value).alias("max_value"),
        F.min(value).alias("min_value"),
        F.count(F.lit(1)).alias("cnt"),
    ]

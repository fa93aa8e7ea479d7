"""Window assigners: from event time in milliseconds to (start, end) columns, half-open, aligned to the epoch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tumbling:
    size: int

    def starts(self, ms: Column) -> Column:
        return F.array(ms - F.pmod(ms, F.lit(self.size)))


@dataclass(frozen=True)
class Sliding:
    """slide may exceed size: rows in the gaps then belong to no window."""

    size: int
    slide: int

    def starts(self, ms: Column) -> Column:
        last = ms - F.pmod(ms, F.lit(self.slide))
        if self.slide >= self.size:
            return F.when(ms < last + self.size, F.array(last)).otherwise(F.array().cast("array<bigint>"))
        panes = -(-self.size // self.slide)
        every = F.array(*[last - i * self.slide for i in range(panes)])
        return every if self.size % self.slide == 0 else F.filter(every, lambda s: s + self.size > ms)


@dataclass(frozen=True)
class Session:
    """Sessions that end after a gap without rows; unmerged, each distinct time opens [ms, ms + gap)."""

    gap: int
    merge: bool = True

    @property
    def size(self) -> int:
        return self.gap

    def starts(self, ms: Column) -> Column:
        return F.array(ms)


@dataclass(frozen=True)
class Global:
    """One window with everything."""


@dataclass(frozen=True)
class Count:
    """Windows of size rows of a key, by arrival; one begins every slide rows (tumbling if slide is None)."""

    size: int
    slide: int | None = None


def max_timestamp(end: Column) -> Column:
    return end - 1


def contains(start: Column, end: Column, ms: Column) -> Column:
    return (ms >= start) & (ms < end)


def intersects(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start < other_end) & (other_start < end)


def cover(start: Column, end: Column, other_start: Column, other_end: Column) -> tuple[Column, Column]:
    return F.least(start, other_start), F.greatest(end, other_end)

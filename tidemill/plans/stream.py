"""A fluent, Column-first interface: streams of rows, keyed, windowed, aggregated; one definition for batches and for Structured Streaming.

Operations apply in the order in which they are written. Everything is lazy until collect(), execute() or a sink.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import Accumulator, Aggregate
from ..functions.triggers import Every, Trigger
from ..functions.windows import Count, Global
from ..operators import keyed, watermarks, windowed
from ..sources import sinks as out
from ..streaming import windows as live


@dataclass(frozen=True)
class StreamConfig:
    """delay: how far event time may be out of order (ms). lateness: how much later a row may still come before it is dropped or put aside.
    ttl: event-time life of keyed state (ms, 0: for ever). spark: settings for the session."""

    delay: int = 5000
    lateness: int = 0
    ttl: int = 0
    checkpoint: str | None = None
    spark: dict[str, str] = field(default_factory=dict)

    def apply(self, spark: SparkSession) -> None:
        for k, v in self.spark.items():
            spark.conf.set(k, v)


@dataclass(frozen=True)
class StreamResult:
    rows: list
    started: float
    ended: float

    @property
    def duration(self) -> float:
        return self.ended - self.started

    @property
    def throughput(self) -> float:
        """Rows a second; 0 for no duration."""
        return len(self.rows) / self.duration if self.duration > 0 else 0.0


@dataclass(frozen=True)
class Stream:
    """Rows with event time in ms (column ms) and an arrival order (order columns, the first numeric)."""

    df: DataFrame
    ms: str = "ms"
    order: tuple[str, ...] = ("sequence_number",)
    config: StreamConfig = StreamConfig()
    sinks: tuple = ()
    strategy: watermarks.WatermarkStrategy | None = None

    def assign_watermarks(self, strategy: watermarks.WatermarkStrategy) -> Stream:
        """Take event times and watermarks from a strategy of one's own; the column ms gets the times."""
        return replace(self, df=self.df.withColumn("ms", strategy.time), ms="ms", strategy=strategy)

    def with_config(self, config: StreamConfig) -> Stream:
        return replace(self, config=config)

    def map(self, **columns: Column) -> Stream:
        """Set columns, in order; a row for which one of them is null leaves the stream."""
        df = self.df
        for name, c in columns.items():
            df = df.withColumn(name, c)
        for name in columns:
            df = df.where(F.col(name).isNotNull())
        return replace(self, df=df)

    def filter(self, condition: Column) -> Stream:
        return replace(self, df=self.df.where(condition))

    def flat_map(self, name: str, values: Column) -> Stream:
        return replace(self, df=self.df.withColumn(name, F.explode(values)))

    def union(self, other: Stream) -> Stream:
        return replace(self, df=self.df.unionByName(other.df))

    def key_by(self, *keys: str, **computed: Column) -> KeyedStream:
        df = self.df
        for name, c in computed.items():
            df = df.withColumn(name, c)
        return KeyedStream(replace(self, df=df), [*keys, *computed])

    def window(self, assigner) -> WindowedStream:
        return WindowedStream(self, [], assigner)

    def with_watermarks(self) -> DataFrame:
        """The rows with rn, wm, previous_wm and emits, as a replay in arrival order."""
        return watermarks.replay(self.df, list(self.order), self.strategy or watermarks.WatermarkStrategy.bounded(F.col(self.ms), self.config.delay))

    def add_sink(self, sink) -> Stream:
        return replace(self, sinks=(*self.sinks, sink))

    def collect(self) -> list:
        return self.df.collect()

    def execute(self) -> list[Exception]:
        """Run into the sinks; the failures of single sinks are returned."""
        return out.fan_out(self.df, list(self.sinks))

    def execute_and_get(self) -> StreamResult:
        began = time.time()
        rows = self.df.collect()
        return StreamResult(rows, began, time.time())

    def start(self, write: Callable[[DataFrame, int], None], mode: str = "append", **trigger):
        """Start a streaming query."""
        return out.stream(self.df, write, self.config.checkpoint, mode, **trigger)


@dataclass(frozen=True)
class KeyedStream:
    stream: Stream
    keys: list[str]

    def aggregate(self, aggregate: Aggregate, value: Column, into: str = "result") -> Stream:
        """The key's aggregate so far, for every row."""
        s = self.stream
        if s.config.ttl:
            return replace(s, df=keyed.running_with_ttl(s.with_watermarks(), self.keys, s.config.ttl, aggregate, value, into, ms=s.ms))
        return replace(s, df=keyed.running_aggregate(s.df, self.keys, list(s.order), aggregate, value, into))

    def reduce(self, value: Column, add: Callable | None = None, builtin: Callable | None = None, into: str = "result") -> Stream:
        s = self.stream
        if s.config.ttl:
            return replace(s, df=keyed.reduce_with_ttl(s.with_watermarks(), self.keys, s.config.ttl, value, into, add, builtin, ms=s.ms))
        return replace(s, df=keyed.running_reduce(s.df, self.keys, list(s.order), value, into, add, builtin))

    def combine(self, accumulator: Accumulator, value: Column, into: str = "result") -> Stream:
        """The final result of a user's aggregate for each key, combined from pieces."""
        return replace(self.stream, df=keyed.combined(self.stream.df, self.keys, accumulator, value, into))

    def map(self, **columns: Column) -> Stream:
        """On the stream below: the key is given up."""
        return self.stream.map(**columns)

    def filter(self, condition: Column) -> Stream:
        """On the stream below: the key is given up."""
        return self.stream.filter(condition)

    def totals(self, *columns: Column) -> Stream:
        return replace(self.stream, df=keyed.totals(self.stream.df, self.keys, list(columns)))

    def window(self, assigner) -> WindowedStream:
        return WindowedStream(self.stream, self.keys, assigner)


@dataclass(frozen=True)
class WindowedStream:
    """emit: 'closed' windows only, or 'all'. late: 'ignore' (part of its window, as all rows are known), 'pane' (a fresh pane for rows after the firing), 'drop' or 'side'."""

    stream: Stream
    keys: list[str]
    assigner: object
    emit: str = "closed"
    late: str = "ignore"
    lateness: int | None = None
    every: int | None = None
    policy: Trigger | None = None

    def trigger(self, when: int | Trigger) -> WindowedStream:
        """Fire by a policy of one's own, or whenever so many rows of a key have come, and begin anew."""
        return replace(self, policy=when) if isinstance(when, Trigger) else replace(self, every=when)

    def map(self, **columns: Column) -> Stream:
        """On the stream below: key and windows are given up."""
        return self.stream.map(**columns)

    def filter(self, condition: Column) -> Stream:
        """On the stream below: key and windows are given up."""
        return self.stream.filter(condition)

    def allowed_lateness(self, ms: int) -> WindowedStream:
        """Rows more than ms behind the watermark that they meet are dropped; 0 drops all late ones."""
        return replace(self, lateness=ms, late="drop")

    def _lateness(self) -> int:
        return self.stream.config.lateness if self.lateness is None else self.lateness

    def side_output_late(self) -> tuple[WindowedStream, DataFrame]:
        """(this without the late rows, the late rows)."""
        on_time, late = windowed.split_late(self.stream.with_watermarks(), self._lateness())
        return replace(self, stream=replace(self.stream, df=on_time.drop("wm", "previous_wm", "emits", "rn")), late="ignore"), late

    def flushed(self) -> WindowedStream:
        return replace(self, emit="all")

    def panes(self) -> WindowedStream:
        return replace(self, late="pane")

    def aggregate(self, *columns: Column, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> Stream:
        """One row for each key and window (and pane or firing), with the aggregate columns; `then` maps the results."""
        s = self.stream
        if s.df.isStreaming:
            return replace(s, df=then(live.aggregate(s.df, s.ms, self.assigner, self.keys, list(columns), s.config.delay)))
        policy = self.policy or (Every(rows=self.every) if self.every and not isinstance(self.assigner, (Count, Global)) else None)
        if policy is not None:
            rows = windowed.triggered(s.with_watermarks(), self.assigner, self.keys, policy, s.config.delay, ms=s.ms, flush=self.emit == "all")
            return replace(s, df=then(rows.groupBy(*self.keys, "window_start", "window_end", "firing").agg(*columns)))
        if isinstance(self.assigner, Count) or isinstance(self.assigner, Global) and self.every:
            count = self.assigner if isinstance(self.assigner, Count) else Count(self.every)
            return replace(s, df=then(windowed.counted(s.df, count, self.keys, list(s.order), list(columns))))
        if isinstance(self.assigner, Global):
            return replace(s, df=then(s.df.groupBy(*self.keys).agg(*columns)))
        if self.late == "pane":
            rows = watermarks.panes(windowed.assign(s.with_watermarks(), self.assigner, s.ms, self.keys))
            return replace(s, df=then(rows.groupBy(*self.keys, "window_start", "window_end", "pane").agg(*columns)))
        df = s.df
        if self.late == "drop":
            df, _ = windowed.split_late(s.with_watermarks(), self._lateness())
        out = windowed.aggregate(df, self.assigner, self.keys, list(columns), "all", s.config.delay, s.ms)
        if self.emit == "closed":  # the last watermark is that of all rows, dropped ones too
            out = out.where(watermarks.closed(s.df, "window_end", s.config.delay, s.ms))
        return replace(s, df=then(out))

    def reduce(self, value: Column, add: Callable | None = None, builtin: Callable | None = None, into: str = "result") -> Stream:
        return self.aggregate((builtin(value) if builtin else windowed.reduce(add, value, self._order())).alias(into))

    def fold(self, zero: Column, add: Callable[[Column, Column], Column], value: Column, into: str = "result") -> Stream:
        return self.aggregate(windowed.fold(zero, add, value, self._order()).alias(into))

    def apply(self, function: Callable[[Column], Column], value: Column, into: str = "result") -> Stream:
        """function gets the window's values, in arrival order, as an array."""
        return self.aggregate(function(windowed.gathered(value, self._order())).alias(into))

    def _order(self) -> Column:
        return F.struct(*self.stream.order)

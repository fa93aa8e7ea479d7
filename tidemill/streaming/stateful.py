"""Keyed state in Structured Streaming: running aggregates, event-time life, count triggers, lists, trigger policies and exact window closing.

The processors keep their state in the session's state store (RocksDB for transformWithState) and see a key's rows of a batch as
pandas frames, with one read and one write of the state a key and batch. Rows are `key string, seq bigint, ms bigint, value double`; with the column `time` under a
watermark where timers are used.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.triggers import Result, Trigger

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
Frames = Iterator[pd.DataFrame]


def _arrived(rows: Frames) -> pd.DataFrame:
    """A key's rows of a batch in arrival order, a null value as 0."""
    df = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable", ignore_index=True)
    df["value"] = df["value"].fillna(0.0)
    return df


def _out(key: tuple, seq, result) -> pd.DataFrame:
    return pd.DataFrame({"key": [key[0]] * len(seq), "seq": np.asarray(seq, np.int64), "result": np.asarray(result, np.float64)})


class RunningSum(StatefulProcessor):
    """The key's sum so far for every row; with ttl, state goes when the watermark passes the last arrival's time by more than that."""

    def __init__(self, ttl: int = 0):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "total double")

    def handleInputRows(self, key, rows: Frames, timerValues) -> Frames:
        df = _arrived(rows)
        so_far = np.cumsum(np.concatenate([[self.total.get()[0] if self.total.exists() else 0.0], df["value"]]))[1:]
        self.total.update((float(so_far[-1]),))
        if self.ttl:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(df["ms"].iloc[-1]) + self.ttl + 1)
        yield _out(key, df["seq"], so_far)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Frames:
        self.total.clear()
        return iter(())

    def close(self) -> None:
        pass


class CountTrigger(StatefulProcessor):
    """Sum of every `size` rows of a key, by arrival; what is left waits in the state."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "rows bigint, total double, fired bigint")

    def handleInputRows(self, key, rows: Frames, timerValues) -> Frames:
        n, total, fired = self.state.get() if self.state.exists() else (0, 0.0, 0)
        df = _arrived(rows)
        window = (np.arange(len(df)) + n) // self.size
        sums = np.bincount(window, df["value"], minlength=int(window[-1]) + 1)
        sums[0] += total
        done = (n + len(df)) // self.size
        self.state.update(((n + len(df)) % self.size, float(sums[done]) if done < len(sums) else 0.0, fired + done))
        if done:
            yield _out(key, fired + np.arange(done), sums[:done])

    def close(self) -> None:
        pass


class LastValues(StatefulProcessor):
    """The mean of the key's last `keep` values after each row; the values are a list state."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getListState("values", "value double")

    def handleInputRows(self, key, rows: Frames, timerValues) -> Frames:
        old = [v[0] for v in self.values.get()] if self.values.exists() else []
        df = _arrived(rows)
        every = np.concatenate([old, df["value"]])
        sums = np.concatenate([[0.0], np.cumsum(every)])
        end = len(old) + 1 + np.arange(len(df))
        begin = np.maximum(end - self.keep, 0)
        self.values.put([(float(v),) for v in every[-self.keep :]])
        yield _out(key, df["seq"], (sums[end] - sums[begin]) / (end - begin))

    def close(self) -> None:
        pass


class ExactWindow(StatefulProcessor):
    """Tumbling sums that fire when the watermark reaches the last millisecond of a window; rows that come later open a fresh pane."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "start bigint", "total double")

    def handleInputRows(self, key, rows: Frames, timerValues) -> Frames:
        df = _arrived(rows)
        for start, total in df["value"].groupby(df["ms"] - df["ms"] % self.size).sum().items():
            old = self.sums.getValue((start,))[0] if self.sums.containsKey((start,)) else 0.0
            self.sums.updateValue((start,), (old + total,))
            self.handle.registerTimer(max(int(start) + self.size - 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Frames:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted(s[0] for s in self.sums.keys() if s[0] + self.size - 1 <= now)
        if due:
            found = _out(key, due, [self.sums.getValue((s,))[0] for s in due])
            for s in due:
                self.sums.removeKey((s,))
            yield found

    def close(self) -> None:
        pass


class TriggeredWindow(StatefulProcessor):
    """Tumbling sums by a trigger policy. The window state is its sum, its number of rows and what the trigger keeps; a row asks the trigger, and so does the watermark that
    reaches the window's last millisecond. Rows that come after a purge begin anew."""

    def __init__(self, size: int, policy: Trigger):
        self.size, self.policy = size, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start bigint", "total double, rows bigint, kept string")

    def _act(self, start: int, total: float, n: int, kept: dict, result: Result) -> tuple[float, int, float | None]:
        fired = total if result.fires and n else None
        return (0.0, 0, fired) if result.purges else (total, n, fired)

    def handleInputRows(self, key, rows: Frames, timerValues) -> Frames:
        df = _arrived(rows)
        out = []
        for start, own in df.groupby(df["ms"] - df["ms"] % self.size, sort=True):
            total, n, kept = self.windows.getValue((start,)) if self.windows.containsKey((start,)) else (0.0, 0, "{}")
            kept = json.loads(kept)
            for ms, value in zip(own["ms"].tolist(), own["value"].tolist(), strict=True):
                total, n, fired = self._act(start, total + value, n + 1, kept, self.policy.on_element(ms, int(start) + self.size, kept))
                if fired is not None:
                    out.append((start, fired))
            self.windows.updateValue((start,), (total, n, json.dumps(kept)))
            self.handle.registerTimer(max(int(start) + self.size - 1, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield _out(key, [s for s, _ in out], [v for _, v in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Frames:
        now = timerValues.getCurrentWatermarkInMs()
        out = []
        for start in sorted(s[0] for s in self.windows.keys() if s[0] + self.size - 1 <= now):
            total, n, kept = self.windows.getValue((start,))
            state = json.loads(kept)
            total, n, fired = self._act(start, total, n, state, self.policy.on_event_time(now, start + self.size, state))
            if fired is not None:
                out.append((start, fired))
            self.windows.removeKey((start,)) if not n else self.windows.updateValue((start,), (total, n, json.dumps(state)))
        if out:
            yield _out(key, [s for s, _ in out], [v for _, v in out])

    def close(self) -> None:
        pass


def run(df: DataFrame, processor: StatefulProcessor, timed: bool = False, delay: int = 0) -> DataFrame:
    """key, seq, result of a processor over streaming rows (key, seq, ms, value); update mode, or append with event time."""
    df.sparkSession.conf.set(*ROCKS)
    if timed:
        df = df.withColumn("time", F.timestamp_millis(F.col("ms"))).withWatermark("time", f"{delay} milliseconds")
    return df.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType="key string, seq bigint, result double", outputMode="append" if timed else "update", timeMode="eventTime" if timed else "none")

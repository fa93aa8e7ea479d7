"""Triggers: when a window's rows become a result, and whether they then leave.

A trigger is asked for every row of a window, for every watermark that the window sees, and, if it names a clock column, for every time on that clock. It may keep
a state of its own for each window (a dict). The same objects drive batch replays (operators.windowed.triggered) and streams (streaming.stateful.TriggeredWindow).
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Result(Enum):
    """(fires, purges)."""

    CONTINUE = (False, False)
    FIRE = (True, False)
    PURGE = (False, True)
    FIRE_AND_PURGE = (True, True)

    @property
    def fires(self) -> bool:
        return self.value[0]

    @property
    def purges(self) -> bool:
        return self.value[1]


@dataclass(frozen=True)
class Trigger:
    """Never fires; the base of all. clock: the name of a column with processing times in ms, for on_processing_time."""

    clock: str | None = None

    def on_element(self, ms: int, end: int, state: dict) -> Result:
        return Result.CONTINUE

    def on_event_time(self, watermark: int, end: int, state: dict) -> Result:
        return Result.CONTINUE

    def on_processing_time(self, now: int, end: int, state: dict) -> Result:
        return Result.CONTINUE


@dataclass(frozen=True)
class EventTime(Trigger):
    """Fires when a watermark reaches the window's last millisecond, and early for a row that lies there."""

    def on_element(self, ms: int, end: int, state: dict) -> Result:
        return Result.FIRE if ms >= end - 1 else Result.CONTINUE

    def on_event_time(self, watermark: int, end: int, state: dict) -> Result:
        return Result.FIRE_AND_PURGE if watermark >= end - 1 else Result.CONTINUE


@dataclass(frozen=True)
class Every(Trigger):
    """Fires whenever `rows` rows have come, and begins anew."""

    rows: int = 1

    def on_element(self, ms: int, end: int, state: dict) -> Result:
        state["n"] = state.get("n", 0) + 1
        if state["n"] < self.rows:
            return Result.CONTINUE
        state["n"] = 0
        return Result.FIRE_AND_PURGE


@dataclass(frozen=True)
class ProcessingTime(Trigger):
    """Fires when the clock reaches the window's last millisecond."""

    clock: str | None = "processing_ms"

    def on_processing_time(self, now: int, end: int, state: dict) -> Result:
        return Result.FIRE_AND_PURGE if now >= end - 1 else Result.CONTINUE


def firings(trigger: Trigger, rows: list[tuple], end: int, last: int | None, flush: bool = False) -> list[list[int]]:
    """For each row of one window, in arrival order, the numbers (from 0) of the firings that hold it.

    rows: (ms, watermark before the row or None, time on the clock or None). Watermarks between two rows of the window count as one, the last of them; `last` is the one
    after all rows. flush: what is left fires at the end.
    """
    state: dict = {}
    held: list[int] = []
    out: list[list[int]] = [[] for _ in rows]
    fired = 0
    seen: int | None = None

    def act(result: Result) -> None:
        nonlocal fired
        if result.fires and held:
            for i in held:
                out[i].append(fired)
            fired += 1
        if result.purges:
            held.clear()

    for i, (ms, before, now) in enumerate(rows):
        if before is not None and (seen is None or before > seen):
            seen = before
            act(trigger.on_event_time(before, end, state))
        held.append(i)
        act(trigger.on_element(ms, end, state))
        if now is not None:
            act(trigger.on_processing_time(now, end, state))
    if last is not None and (seen is None or last > seen):
        act(trigger.on_event_time(last, end, state))
    if flush:
        act(Result.FIRE_AND_PURGE)
    return out

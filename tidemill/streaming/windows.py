"""Windowed aggregation of streaming DataFrames. A window is emitted once the watermark has reached its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import Session


def aggregate(df: DataFrame, ms: str, assigner, keys: list[str], columns: list[Column], delay: int) -> DataFrame:
    """Append-mode aggregation by key and window, with window_start and window_end in ms."""
    timed = df.withColumn("_time", F.timestamp_millis(F.col(ms))).withWatermark("_time", f"{delay} milliseconds")
    if isinstance(assigner, Session):
        own = F.session_window("_time", f"{assigner.gap} milliseconds")
    else:
        slide = getattr(assigner, "slide", None) or assigner.size
        if slide > assigner.size:  # rows between windows go; then the windows tumble
            timed = timed.where(F.pmod(F.col(ms), F.lit(slide)) < assigner.size)
            own = F.window("_time", f"{slide} milliseconds")
        else:
            own = F.window("_time", f"{assigner.size} milliseconds", f"{slide} milliseconds")
    out = timed.groupBy(*keys, own.alias("_w")).agg(*columns)
    end = F.unix_millis("_w.end")
    if not isinstance(assigner, Session) and (getattr(assigner, "slide", None) or 0) > assigner.size:
        end = F.unix_millis("_w.start") + assigner.size
    return out.withColumn("window_start", F.unix_millis("_w.start")).withColumn("window_end", end).drop("_w")

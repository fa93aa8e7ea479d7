"""Event time as epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since the epoch of a TIMESTAMP_NTZ (or of a TIMESTAMP's wall clock), whatever the session's time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000 + F.hour(ts) * F.lit(3_600_000) + F.minute(ts) * F.lit(60_000) + F.floor(micros / 1000)


def latency_ms(processing: Column, event: Column) -> Column:
    """Processing time minus event time, which may be negative."""
    return epoch_ms(processing) - epoch_ms(event)


def is_late(ms: Column, watermark: Column) -> Column:
    """A row is late if its event time is below the watermark that was there when it came; without one, it is not."""
    return F.coalesce(ms < watermark, F.lit(False))

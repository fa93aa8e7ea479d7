"""Writing: files, console, memory, Kafka, several sinks at once, and idempotent batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .readers import KafkaSinkConfig

Sink = Callable[[DataFrame], None]


def console(rows: int = 20) -> Sink:
    return lambda df: df.show(rows, False)


class Collect:
    """Keeps what it is given on the driver; for small results."""

    def __init__(self):
        self.rows: list = []

    def __call__(self, df: DataFrame) -> None:
        self.rows.extend(df.collect())

    def take(self) -> list:
        out, self.rows = self.rows, []
        return out


def parquet(path: str, mode: str = "append") -> Sink:
    return lambda df: df.write.mode(mode).parquet(path)


def kafka(config: KafkaSinkConfig, key: str = "key") -> Sink:
    """Rows as JSON values; needs Spark's Kafka connector."""
    return lambda df: to_messages(df, key).write.format("kafka").options(**config.options()).save()


def to_messages(df: DataFrame, key: str = "key") -> DataFrame:
    named = F.col(key).cast("string") if key in df.columns else F.lit(None).cast("string")
    return df.select(named.alias("key"), F.to_json(F.struct("*")).alias("value"))


def fan_out(df: DataFrame, sinks: list[Sink]) -> list[Exception]:
    """Give df to every sink; a failing one does not stop the others. The failures are returned."""
    df = df.persist() if len(sinks) > 1 else df
    failed = []
    try:
        for sink in sinks:
            try:
                sink(df)
            except Exception as e:  # noqa: BLE001  reported to the caller
                failed.append(e)
    finally:
        df.unpersist()
    return failed


def idempotent(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch replaces a folder of its own, so a batch that is run again leaves the same rows once."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stream(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Start a stream with foreachBatch; availableNow unless a trigger is given."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()

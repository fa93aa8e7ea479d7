"""Running streams: settings, a run to the end of what is there, progress."""

from __future__ import annotations

import json
import tempfile
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local one only where that is unset and the session is local, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.gettempdir()


@dataclass(frozen=True)
class CheckpointConfig:
    """Where state and offsets are kept, how often a batch runs, how many versions stay; incremental writes changes of RocksDB state only."""

    location: str
    interval: str = "1 minute"
    retain: int = 10
    incremental: bool = True

    def apply(self, spark: SparkSession) -> None:
        spark.conf.set("spark.sql.streaming.minBatchesToRetain", str(self.retain))
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", str(self.incremental).lower())

    def start(self, df: DataFrame, write, mode: str = "append") -> StreamingQuery:
        """Start a query whose batches, each of which is a checkpoint, begin every interval; write takes (batch, number) and should be idempotent."""
        self.apply(df.sparkSession)
        return df.writeStream.outputMode(mode).option("checkpointLocation", self.location).foreachBatch(write).trigger(processingTime=self.interval).start()


@dataclass
class Checkpoint:
    """A batch of a query, as its checkpoint: IN_PROGRESS, COMPLETED or FAILED."""

    query: str
    batch: int
    state: str = "IN_PROGRESS"
    rows: int = 0
    error: str | None = None


class Checkpoints(StreamingQueryListener):
    """The life of checkpoints: a batch's is completed when its progress is reported, and the one in the making fails with its query. The last `retain` completed ones are kept.

    Register it with spark.streams.addListener().
    """

    def __init__(self, retain: int = 10):
        self.completed: deque[Checkpoint] = deque(maxlen=retain)
        self.failed: deque[Checkpoint] = deque(maxlen=retain)
        self.pending: dict[str, Checkpoint] = {}

    def latest(self) -> Checkpoint | None:
        return self.completed[-1] if self.completed else None

    def onQueryStarted(self, event) -> None:
        self.pending[str(event.id)] = Checkpoint(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.completed.append(Checkpoint(str(p.id), p.batchId, "COMPLETED", p.numInputRows))
        self.pending[str(p.id)] = Checkpoint(str(p.id), p.batchId + 1)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        now = self.pending.pop(str(event.id), None)
        if now and event.exception:
            now.state, now.error = "FAILED", event.exception
            self.failed.append(now)


def offsets(query: StreamingQuery) -> list[dict]:
    """A snapshot of what each source of a query has read to: for Kafka {topic: {partition: next offset}}. KafkaSourceConfig.at() starts there again."""
    p = query.lastProgress
    return [s["endOffset"] for s in json.loads(p.json)["sources"]] if p else []


def state_backend(spark: SparkSession, kind: str = "rocksdb") -> None:
    """memory: state on the heap, backed by files; rocksdb: state on disk."""
    names = {"memory": "HDFSBackedStateStoreProvider", "rocksdb": "RocksDBStateStoreProvider"}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", f"org.apache.spark.sql.execution.streaming.state.{names[kind]}")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over all that is there, into Parquet (exactly once), and return what was written."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def status(query: StreamingQuery) -> dict:
    """State, batch, input rows, rates, watermark and late rows of a query."""
    p = query.lastProgress
    return {
        "active": query.isActive,
        "message": query.status["message"],
        "batch": p.batchId if p else None,
        "input_rows": p.numInputRows if p else 0,
        "rows_per_second": p.processedRowsPerSecond if p else 0.0,
        "watermark": (p.eventTime or {}).get("watermark") if p else None,
        "late_rows": sum(o.numRowsDroppedByWatermark for o in p.stateOperators) if p else 0,
    }

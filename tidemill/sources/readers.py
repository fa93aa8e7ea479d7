"""Reading: tables and files, collections with event times, sockets, Kafka topics and file-backed topics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The envelope of a record.
RECORD = "key string, value string, event_time timestamp, processing_time timestamp, ingestion_time timestamp, attributes map<string,string>, partition int, sequence_number bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, fmt: str, path: str, schema: str | StructType | None = None, streaming: bool = False, max_files: int | None = None, **options) -> DataFrame:
    """Parquet, ORC, JSON, CSV or text files, as a batch or as a stream of new files."""
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple | None = None, partitions: int = 1, **options) -> DataFrame:
    """A table of a database; with a numeric or time column and its bounds, in so many ranges of it at once. Conditions and columns are pushed down. Needs the driver on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, column, bounds, partitions), **options).load()


def jdbc_options(url: str, table: str, column: str | None = None, bounds: tuple | None = None, partitions: int = 1) -> dict[str, str]:
    out = {"url": url, "dbtable": table}
    if column is None:
        return out
    if bounds is None:
        raise ValueError("a partition column needs bounds")
    return out | {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}


def collection(spark: SparkSession, values: Iterable, schema: str, event_time_ms: Callable | None = None) -> DataFrame:
    """A small local collection with sequence_number in its order and, with an extractor, ms as event time (null without one)."""
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    data = [(*r, i, event_time_ms(r if len(r) > 1 else r[0]) if event_time_ms else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"{schema}, sequence_number bigint, ms bigint")


def records(df: DataFrame, key: str, value: str, ts: str, seq: str, processing: str | None = None) -> DataFrame:
    """Any table as envelopes: ordered by event time and sequence number, attributes empty. processing: the column with the time at which a row came and was processed (else its event time)."""
    return df.select(
        F.col(key).cast("string").alias("key"),
        F.col(value).cast("string").alias("value"),
        F.col(ts).cast("timestamp").alias("event_time"),
        F.col(processing or ts).cast("timestamp").alias("processing_time"),
        F.col(processing or ts).cast("timestamp").alias("ingestion_time"),
        F.create_map().cast("map<string,string>").alias("attributes"),
        F.lit(0).alias("partition"),
        F.col(seq).cast("bigint").alias("sequence_number"),
    )


def socket_text(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


@dataclass(frozen=True)
class KafkaSourceConfig:
    """Where and how to read a topic; options() are those of Spark's Kafka source, which needs its connector on the class path."""

    servers: str
    topic: str
    group: str = "tidemill"
    start: str = "latest"
    exactly_once: bool = False
    max_records: int = 500
    poll_ms: int = 100

    def at(self, offsets: dict[str, dict]) -> KafkaSourceConfig:
        """The same from a snapshot {topic: {partition: next offset}} on (streaming.runtime.offsets); topics may have any name."""
        return replace(self, start=json.dumps({t: {str(p): int(o) for p, o in by.items()} for t, by in offsets.items()}, sort_keys=True))

    def options(self) -> dict[str, str]:
        out = {
            "kafka.bootstrap.servers": self.servers,
            "subscribe": self.topic,
            "kafka.group.id": self.group,
            "startingOffsets": self.start,
            "maxOffsetsPerTrigger": str(self.max_records),
            "kafkaConsumer.pollTimeoutMs": str(self.poll_ms),
        }
        return out | ({"kafka.isolation.level": "read_committed"} if self.exactly_once else {})


@dataclass(frozen=True)
class KafkaSinkConfig:
    servers: str
    topic: str
    acks: str = "1"
    idempotent: bool = True
    compression: str = "lz4"
    batch_bytes: int = 16384
    linger_ms: int = 5
    retries: int = 3
    timeout_ms: int = 30_000

    def options(self) -> dict[str, str]:
        return {
            "kafka.bootstrap.servers": self.servers,
            "topic": self.topic,
            "kafka.acks": "all" if self.idempotent else self.acks,
            "kafka.enable.idempotence": str(self.idempotent).lower(),
            "kafka.compression.type": self.compression,
            "kafka.batch.size": str(self.batch_bytes),
            "kafka.linger.ms": str(self.linger_ms),
            "kafka.retries": str(self.retries),
            "kafka.request.timeout.ms": str(self.timeout_ms),
        }


@dataclass(frozen=True)
class KafkaConfig:
    """One description of a connection for both ends."""

    servers: str
    topic: str
    group: str = "tidemill"
    exactly_once: bool = False

    def source(self, **more) -> KafkaSourceConfig:
        return KafkaSourceConfig(self.servers, self.topic, self.group, exactly_once=self.exactly_once, **more)

    def sink(self, topic: str | None = None, **more) -> KafkaSinkConfig:
        return KafkaSinkConfig(self.servers, topic or self.topic, **more)


def kafka(spark: SparkSession, config: KafkaSourceConfig, streaming: bool = True) -> DataFrame:
    """Envelopes of a topic; topic, offset and partition are attributes. Offsets live in the query's checkpoint."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    return from_topic(reader.options(**config.options()).load())


def kafka_text(spark: SparkSession, servers: str, topic: str, group: str = "tidemill") -> DataFrame:
    return kafka(spark, KafkaSourceConfig(servers, topic, group)).select("value", "event_time", "attributes")


def from_topic(raw: DataFrame) -> DataFrame:
    """Rows of a topic (topic, partition, offset, timestamp, key, value) as envelopes; file-backed topics have the same columns."""
    return raw.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").alias("event_time"),
        F.current_timestamp().alias("processing_time"),
        F.current_timestamp().alias("ingestion_time"),
        F.create_map(F.lit("topic"), F.col("topic"), F.lit("offset"), F.col("offset").cast("string"), F.lit("partition"), F.col("partition").cast("string")).alias("attributes"),
        F.col("partition").cast("int").alias("partition"),
        F.col("offset").cast("bigint").alias("sequence_number"),
    )


def file_topic(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """A topic kept as Parquet files, for tests and replays."""
    return from_topic(files(spark, "parquet", path, "topic string, partition int, offset bigint, timestamp timestamp, key binary, value binary", streaming))

"""A versioned key-value table and a pre-aggregated rollup, on Parquet.

The change log has the columns key, value, seq, deleted: an update appends a row with a higher seq, a deletion a tombstone. Reading takes the newest row of each key;
compaction rewrites the log as just those. Files are sorted by key when written, so point and range reads skip row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def put(log: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The log with rows (key, value, seq) as new versions."""
    new = rows.select("key", "value", "seq", F.lit(False).alias("deleted"))
    return new if log is None else log.unionByName(new)


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log with tombstones for keys (key, seq)."""
    return log.unionByName(keys.select("key", F.lit(None).cast(log.schema["value"].dataType).alias("value"), "seq", F.lit(True).alias("deleted")))


def newest(log: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones included: an aggregate with partial results, and no window per key."""
    top = F.max_by(F.struct("value", "deleted"), F.col("seq"))
    return log.groupBy("key").agg(top.alias("t"), F.max("seq").alias("seq")).select("key", "t.value", "seq", "t.deleted")


def latest(log: DataFrame) -> DataFrame:
    return newest(log).where(~F.col("deleted")).select("key", "value", "seq")


def get(log: DataFrame, key) -> DataFrame:
    return latest(log.where(F.col("key") == F.lit(key)))


def scan(log: DataFrame, start, end) -> DataFrame:
    """Keys from start to end, both included, in key order."""
    return latest(log.where(F.col("key").between(start, end))).orderBy("key")


def compact(log: DataFrame) -> DataFrame:
    """One version for each key. It keeps its seq, so later versions still win; tombstones stay."""
    return newest(log)


class Store:
    """A change log in a folder of Parquet segments."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "key string, value string, seq bigint, deleted boolean"):
        self.spark, self.path, self.schema = spark, path, schema

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/gen=*")

    def _generations(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()[4:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("gen=")) if fs.exists(folder) else []

    def flush(self, rows: DataFrame) -> None:
        """Append rows (key, value, seq, deleted) as a segment, sorted by key within files."""
        at = (self._generations() or [0])[-1] + 1
        rows.repartitionByRange("key").sortWithinPartitions("key", "seq").write.mode("errorifexists").parquet(f"{self.path}/gen={at}")

    def compact(self) -> None:
        """Write the newest versions as a segment that supersedes the earlier ones, then remove those."""
        old = self._generations()
        self.flush(newest(self.log()))
        jvm = self.spark._jvm
        for g in old:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/gen={g}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def stats(self) -> DataFrame:
        """segments, versions, keys, tombstones."""
        log = self.log().withColumn("f", F.input_file_name())
        return log.agg(F.countDistinct("f").alias("segments"), F.count(F.lit(1)).alias("versions"), F.countDistinct("key").alias("keys"), F.sum(F.col("deleted").cast("long")).alias("tombstones"))


    def segments(self) -> list[Segment]:
        """The generations with their sizes in bytes, oldest first."""
        jvm, out = self.spark._jvm, []
        for g in self._generations():
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/gen={g}")
            out.append(Segment(str(g), at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()))
        return out

    def compact_some(self, least: int = 4, ratio: float = 1.5) -> list[str]:
        """Merge a run of neighbouring segments of like sizes, if there is one, into one that takes the place of the newest; returns their names."""
        run = size_tiered(self.segments(), least, ratio)
        if run:
            paths = [f"{self.path}/gen={s.name}" for s in run]
            merged = newest(self.spark.read.schema(self.schema).parquet(*paths))
            jvm, temporary = self.spark._jvm, f"{self.path}/merging-{run[-1].name}"
            merged.repartitionByRange("key").sortWithinPartitions("key", "seq").write.mode("overwrite").parquet(temporary)
            for p in paths:
                at = jvm.org.apache.hadoop.fs.Path(p)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            at = jvm.org.apache.hadoop.fs.Path(temporary)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(at, jvm.org.apache.hadoop.fs.Path(paths[-1]))
        return [s.name for s in run]


@dataclass(frozen=True)
class Segment:
    name: str
    size: int
    level: int = 0


def size_tiered(segments: list[Segment], least: int = 4, ratio: float = 1.5) -> list[Segment]:
    """The first run of `least` or more neighbouring segments whose sizes stay within ratio of the run's smallest."""
    for i in range(len(segments)):
        run = [segments[i]]
        for s in segments[i + 1 :]:
            sizes = [x.size for x in (*run, s)]
            if max(sizes) > ratio * max(1, min(sizes)):
                break
            run.append(s)
        if len(run) >= least:
            return run
    return []


def leveled(segments: list[Segment], base: int = 10 << 20, factor: int = 10) -> list[Segment]:
    """The segments of the first level that holds more than one, or more than its size allows."""
    for n in sorted({s.level for s in segments}):
        own = [s for s in segments if s.level == n]
        if len(own) > 1 or sum(s.size for s in own) > base * factor**n:
            return own
    return []


def rollup(df: DataFrame, partition: str, key: str, ms: str, columns: list[Column]) -> DataFrame:
    """Pre-aggregated rows by (partition, key, time)."""
    return df.groupBy(F.col(partition).alias("partition_key"), F.col(key).alias("primary_key"), F.col(ms).alias("ts_ms")).agg(*columns)


def rollup_batches(df: DataFrame, batch: Column, partition: str, key: str, ms: str, columns: list[Column]) -> DataFrame:
    """Pre-aggregation within each insert batch: one row for each batch, partition and key, at the latest time of the batch."""
    return df.groupBy(batch.alias("batch"), F.col(partition).alias("partition_key"), F.col(key).alias("primary_key")).agg(F.max(ms).alias("ts_ms"), *columns)


def rollup_scan(rolled: DataFrame, partition, start, end) -> DataFrame:
    """A partition's rows with keys from start to end, both included, by key and time."""
    return rolled.where((F.col("partition_key") == F.lit(partition)) & F.col("primary_key").between(start, end)).orderBy("primary_key", "ts_ms")


def merge_ratio(df: DataFrame, partition: str, key: str, ms: str) -> DataFrame:
    """Per partition: rows, distinct (key, time) and the share of rows that merged into one already there."""
    by = df.groupBy(F.col(partition).alias("partition_key"), F.col(key), F.col(ms)).agg(F.count(F.lit(1)).alias("n"))
    out = by.groupBy("partition_key").agg(F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("merged_rows"))
    return out.withColumn("ratio", F.round(1 - F.col("merged_rows") / F.col("total_rows"), 6))

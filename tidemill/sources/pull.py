"""Sources of one's own: any iterator of rows as a batch or a stream, through Spark's Python data source interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def pull_source(name: str, schema: str, read: Callable[[int], Iterator[tuple]], partitions: int = 1, poll: Callable[[int], tuple[list[tuple], int]] | None = None) -> type[DataSource]:
    """A data source class. read(i) iterates over the rows of partition i, on an executor, and is called again if that is lost.

    poll(offset) gives the rows from an offset on that there are now, and the next offset: it makes the source a stream, whose offsets are in the query's
    checkpoint. It must give the same rows for the same offset again. Both must be picklable.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(i) for i in range(partitions)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return iter(read(partition.value))

    class Polling(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"at": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, after = poll(start["at"])
            return iter(rows), {"at": after}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            rows, _ = poll(start["at"])
            return iter(rows[: end["at"] - start["at"]])

    class Pull(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Polling()

    return Pull


def pull(spark: SparkSession, source: type[DataSource], streaming: bool = False) -> DataFrame:
    """Rows of a source from pull_source()."""
    spark.dataSource.register(source)
    return (spark.readStream if streaming else spark.read).format(source.name()).load()

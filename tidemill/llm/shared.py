"""Session helpers: reading tables, cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark.sparkContext, "_tidemill_dir", None) or tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext._tidemill_dir = at
    return at


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, any executor may be lost afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemill_path = path
    _written(spark).add(path)
    return out


def _written(spark: SparkSession) -> set[str]:
    """Paths of the tables of this session that are still there."""
    context = spark.sparkContext
    if not hasattr(context, "_tidemill_tables"):
        context._tidemill_tables = set()
    return context._tidemill_tables


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written(spark).discard(at)


def discard(*tables: DataFrame, free: bool = False) -> None:
    """Delete tables that materialize() wrote, once nothing will read them again. free: also the shuffle files behind them, where those are large."""
    for df in tables:
        _delete(df.sparkSession, df._tidemill_path)
    if free:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()  # shuffle files go when the driver's references to them do


def sweep(spark: SparkSession) -> int:
    """Delete all tables that results of this session still read from; call it when those results are written. Returns how many there were."""
    left = list(_written(spark))
    for at in left:
        _delete(spark, at)
    return len(left)


def smallest(df: DataFrame, by: str, n: int, total: int) -> DataFrame:
    """The rows of df (of `total`) whose 64-bit hash `by` is among the n smallest, ties of the last included.

    Only hashes are ordered, and of those only the share that can be among the smallest: hashes are even, so one filter leaves
    little more than n of them, however many partitions there are.
    """
    share = 1.2 * n / max(total, 1) + 1e-6
    while True:
        top = F.lit(int(-(1 << 63) + min(1.0, share) * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1)
        cut = df.select(by).where(F.col(by) <= top).orderBy(by).limit(n).agg(F.count(F.lit(1)), F.max(by)).first()
        if cut[0] >= n or share >= 1:
            return df.where(F.col(by) <= F.lit(cut[1] if cut[1] is not None else -(1 << 63)))
        share *= 4


def trim() -> None:
    """Give memory that Arrow and NumPy freed back to the system, where the C library can: a worker is used for task after task, and waits between them beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A scan of Arrow batches that leaves a small worker behind."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from scan(batches)
        finally:
            trim()

    return run


def ascii_lower(col):
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def opaque(col):
    """The same column, but not to be computed again inside conditions or lambdas further up.

    The optimizer moves a condition below a projection by putting the column's expression in its place; for arrays that lambdas read that means once for each element. It
    does not do so with what is not a function of the row. (It sees through conditions on rand().)
    """
    return F.when(F.monotonically_increasing_id() >= 0, col)


def row_key(df: DataFrame, *cols: str):
    """A 64-bit key of a row's content. Repeated rows share it, by design: callers keep their multiplicity."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in cols])

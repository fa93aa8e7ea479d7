"""Global prefix sums over one total order, from per-partition totals."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, materialize

RANGE = 1 << 20  # rows of a range, about


def running_totals(rows: DataFrame, order: list[str], values: list[str], group: str | None = None, range_rows: int = RANGE) -> DataFrame:
    """rows with before_<v> for each v of values: the sum of v (integers) over the rows before, within the group; written to the shared folder.

    The rows are dealt out by ranges of (group, *order) of about range_rows rows, so a hot group spans as many ranges as its rows need, and more rows
    make more ranges. Only totals reach the driver: one row for each range and group in it, at most ranges + groups rows, since ranges
    follow one another. Rows that are equal in all of the order are interchangeable; a number tells them apart, so that
    they too spread over ranges. Within a range a window runs, which spills.
    """
    keys = ([group] if group else []) + order
    narrow = materialize(rows.withColumn("_tie", F.monotonically_increasing_id()), "rows")  # sampling for the ranges reads these narrow rows, not the texts again
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-narrow.count() // range_rows))
    placed = materialize(narrow.repartitionByRange(n, *keys, "_tie").withColumn("_part", F.spark_partition_id()), "ranged")
    sums = placed.groupBy("_part", *([group] if group else [])).agg(*[F.sum(v).alias(v) for v in values]).collect()
    run: dict = defaultdict(lambda: [0] * len(values))
    offsets = []
    for r in sorted(sums, key=lambda r: r["_part"]):
        g = r[group] if group else None
        offsets.append((r["_part"], g, *run[g]))
        run[g] = [a + (r[v] or 0) for a, v in zip(run[g], values, strict=True)]
    kind = placed.schema[group].dataType if group else T.IntegerType()
    names = [f"_from_{v}" for v in values]
    schema = T.StructType([T.StructField("_at", T.IntegerType()), T.StructField("_group", kind), *[T.StructField(c, T.LongType()) for c in names]])
    start = rows.sparkSession.createDataFrame(offsets, schema)  # at most ranges + groups rows
    within = Window.partitionBy("_part", *([group] if group else [])).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_part") == F.col("_at")
    if group:
        same = same & F.col(group).eqNullSafe(F.col("_group"))
    summed = placed.join(F.broadcast(start), same)
    before = [(F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(c)).cast("long").alias(f"before_{v}") for v, c in zip(values, names, strict=True)]
    out = materialize(summed.select(*rows.columns, *before), "summed")
    discard(narrow, placed)
    return out

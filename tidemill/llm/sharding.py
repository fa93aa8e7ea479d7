"""Contiguous balanced shards from global byte-size prefix sums.

Rows are put into one global order, each partition reports its totals, the driver adds those up (one row a partition,
never a row a document), and each row's prefix sum is its partition's offset plus its own running sum. Cutting the
prefix sums at equal targets gives the shards.

The order is by content (CRC and hash of the text, then doc_id), so equal texts are neighbours and share a shard wherever
no cut falls between them. A group larger than a shard is split by the cuts: one group of copies with a third of all
rows fills as many shards as its bytes need, and no task ever holds it whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals


def assign_shards(docs: DataFrame, n_shards: int = 40, overhead: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (from 0 within its shard), start (sum of the sizes before the row).

    A row belongs to the shard in which its middle byte falls, so a shard misses its target by one row's size at most.

    A null text has no bytes and a size of `overhead`; repeated rows are rows of their own, with slots of their own; an
    empty table gives no rows; other columns, whatever their names, are neither read nor returned. Where every size is 0,
    all rows are in shard 0.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"),
        F.lit(1).cast("long").alias("one"),
    )
    summed = running_totals(rows, ["text_crc32", "_h", "doc_id"], ["size", "one"])
    total = summed.agg(F.sum("size")).first()[0] or 1
    middle = F.col("before_size").cast("decimal(38,0)") * 2 + F.col("size")
    shard = F.least(F.floor(middle * n_shards / F.lit(2 * total).cast("decimal(38,0)")), F.lit(n_shards - 1)).cast("int")
    placed = summed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("before_one").alias("_first"))  # shards are contiguous; n_shards rows
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("before_one") - F.col("_first")).alias("slot"), F.col("before_size").alias("start"))

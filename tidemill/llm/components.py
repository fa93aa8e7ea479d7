"""Connected components of an edge table, by alternating large-star and small-star steps; nothing reaches the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs). Returns u, root: for every vertex of an edge but the smallest of its component, that smallest one.

    Each round is an aggregate with partial sums and a join on the vertex, so a vertex with very many edges is dealt with as any skewed join key.
    """
    now = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        small = materialize(small, "small")
        discard(now, large)
        now, was = small, mark
        mark = _mark(now)
        if mark == was:
            out = now.select("u", F.col("v").alias("root"))
            out._tidemill_path = now._tidemill_path  # for the caller to discard
            return out


def _mark(edges: DataFrame) -> tuple:
    """A summary of an edge table that changes when it does."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / w: u is uniform, from a hash of its content and a seed, and w its quality weight.
Documents are sorted by that key within their source and their sizes prefix-summed there. A source whose target is t
times its size gives floor(t) complete epochs and then the documents at the head of that order, up to the rest of its
budget: a weighted sample without replacement. Only one row a source and one row a partition reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals
from .shared import materialize

WORD = r"[^\x20\x09-\x0D]+"


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1, falling with the share of symbols in the text."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return F.greatest(F.lit(0.05), F.coalesce(1 - 10 * symbols / F.greatest(F.char_length(text), F.lit(1)), F.lit(0.05)))


def targets(sizes: dict, weights: tuple = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> dict:
    """The target of each source: weights repeat over the sources by code point, null last; share of all sizes in all.

    A target stops at limit times its source's size; the excess is dealt out again by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), list(names)
    while free:
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if unit * w[s] >= limit * sizes[s]]
        if not over:
            return out | {s: unit * w[s] for s in free}
        out |= {s: limit * sizes[s] for s in over}
        left -= sum(limit * sizes[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def mix(docs: DataFrame, seed: int = 17, weights: tuple = (3, 1, 2), share: float = 1.5, limit: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies (how often the mix holds the document), row_key.

    size is the number of words. Sources form a small vocabulary (one driver row each). A null source is a source of
    its own, last in order; a null or empty text has size 0 and is taken as often as its place in the order says, with 0
    words; ties of the key are broken by doc_id and content; equal rows have equal keys and are interchangeable; an empty
    table gives no rows; other columns are not read.
    """
    return _mix(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), seed, weights, share, limit).drop("rid")


def _mix(docs: DataFrame, seed: int = 17, weights: tuple = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """mix() of doc_id, source and text, and of rid (a row's number) where that is there."""
    t = F.coalesce(F.col("text"), F.lit(""))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), t), 11) + 0.5) / float(1 << 53)
    rows = docs.select(
        "doc_id",
        "source",
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"),
        F.round(-F.ln(u) / quality_weight(t), 12).alias("key"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), t, F.col("text").isNull()).alias("row_key"),
        (F.col("rid") if "rid" in docs.columns else F.lit(None).cast("long")).alias("rid"),
    )
    summed = running_totals(rows, ["key", "doc_id", "row_key"], ["size"], "source")
    sizes = {r[0]: r[1] for r in summed.groupBy("source").agg(F.sum("size")).collect()}
    goal = targets(sizes, weights, share, limit)
    plan = docs.sparkSession.createDataFrame([(s, sizes[s], float(goal[s])) for s in sizes], "s string, source_size long, target double")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    more = (2 * F.col("before_size") + F.col("size") <= 2 * rest) & (epochs < limit) & (rest > 0)
    return (
        summed.join(plan, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", (epochs + more.cast("long")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "row_key", "rid")
    )


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it; columns as they were, whatever their names.

    Rows are numbered first (in a table of the shared folder) and joined by that number, so rows that are equal in id and text but differ in other columns each
    keep their own, and a group of repeated rows is no hot key. Nulls, empty texts, ties and empty tables as in mix().
    """
    own = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid")), "mixing")
    taken = _mix(own.select(F.col("row")[doc_id].alias("doc_id"), F.col("row")[source].alias("source"), F.col("row")[text].alias("text"), "rid"), **how)
    found = own.join(taken.where("copies > 0").select("rid", "copies"), "rid")
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")

"""From raw documents to shards of a training mix: five stages, each one operator of tidemill.llm.

Every stage takes all rows that the one before kept and writes what it decides; all but the last return the columns of documents. The last returns the
manifest of the shards: one row for each row of the mix, with its shard and place.

In every stage a null text counts as an empty one, texts are read whole whatever their length, ties and repeated rows are decided as the operators' docstrings say, an empty table gives an
empty one with the same columns, and further columns stay, whatever their names (the manifest has only its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import langid
from tidemill.llm.decontaminate import decontaminate
from tidemill.llm.mixing import mixed
from tidemill.llm.neardup import drop_near_duplicates
from tidemill.llm.shared import discard, materialize, table
from tidemill.llm.sharding import assign_shards


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without a letter or with a poor score go (without labelled ones, those without a letter). Null and empty texts go; repeated rows stay."""
    return langid.accept(docs, langid.train(docs), least=0.4)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: words in fives, similarity of 0.8 or more. Documents without words stay, once for each id and text; of repeated rows one stays."""
    return drop_near_duplicates(docs, percent=80, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage of ten words. Null and empty texts stay; an empty benchmark takes nothing away."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix of sources; a row for each time a document is taken. A null source is one of its own; documents without words are taken by their place in the order."""
    return mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of the mix."""
    return assign_shards(docs, n_shards=40).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: Trained and hashed stages have no SQL equivalent; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again. tidemill.llm.shared.sweep() deletes what is left there, once the result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
            if before is not None:
                discard(before)  # written for this stage alone
            before = docs
    return docs.withColumn("shard", F.col("shard").cast("int"))

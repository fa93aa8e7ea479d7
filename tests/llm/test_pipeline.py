import zlib
from collections import Counter

import corpus_pipeline
from tests.llm import corpus
from tests.llm.test_operators import components, hits
from tidemill.llm import queries


def test_every_stage_decides(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = {n: f for n, f in corpus_pipeline.STAGES}
    lettered = first["language"](spark, docs, sf)
    assert lettered.columns == docs.columns and lettered.count() >= 0.97 * docs.count()
    single = first["near_dedup"](spark, lettered, sf).cache()
    want = {c for _, n, c in components(lettered.collect(), 80) if n}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns
    clean = first["decontamination"](spark, single, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, _, n, _ in hits([(r.doc_id, r.text) for r in single.collect()], items) if n}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad
    mixture = first["mixture"](spark, clean, sf).cache()
    assert mixture.columns == docs.columns and max(Counter(r.doc_id for r in mixture.collect()).values()) <= 2
    out = first["shards"](spark, mixture, sf).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in out) == Counter((r.doc_id, zlib.crc32(r.text.encode())) for r in mixture.collect())


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and {r.shard for r in out} <= set(range(40))


def test_stages_take_awkward_and_empty_tables(spark, sf):
    docs = corpus.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
        docs = stage(spark, docs, sf).cache()
        assert docs.count() > 0, name


def test_queries_cover_all_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))

"""Clashing names, rows that share ids, and texts longer than any piece of work, for every operator."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import corpus
from tidemill.llm import langid, licences, mixing, neardup, quality, rules
from tidemill.llm.decontaminate import contamination, decontaminate
from tidemill.llm.induced import descending, suffix_lcp
from tidemill.llm.shared import materialize, smallest, sweep
from tidemill.llm.sharding import assign_shards
from tidemill.llm.substrings import dedup_words
from tidemill.llm.suffixdedup import dedup_bytes

#: Names that the operators use inside.
INNER = "_words _lines _spans _twice _copies _row_key _k _k2 _id _y _h _contamination _lang_pred _lang_score _row _text _t _w _n row rid k h class root kept key size one before_size spans copies asked found taken target pred licences dedup contamination".split()


def clashing(spark, seed=7, n=20):
    docs = corpus.documents(spark, seed, n).select("doc_id", "text", "lang", "source", "n_chars")
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in INNER])


def test_no_name_clashes(spark):
    docs = clashing(spark)
    bench = spark.createDataFrame([(1, "some benchmark item that nobody has")], "item_id int, text string")
    model = rules.Ensemble(0.0, [((("n_words", True, 5.0),), 1.0)])
    lang = langid.train(docs)
    n = docs.count()

    def own(out, but=()):
        row = out.first()
        assert all(row[c] == f"own {c}" for c in INNER if c not in but) and set(docs.columns) <= set(out.columns)
        return out

    assert own(quality.score(docs), ["kept"]).count() == n
    assert own(rules.score(docs, model)).count() == n
    assert own(licences.scan(docs), ["licences"]).count() == n
    assert own(contamination(docs, bench), ["contamination"]).count() == own(decontaminate(docs, bench)).count() == n
    assert own(dedup_bytes(docs), ["dedup"]).count() == own(dedup_words(docs), ["dedup"]).count() == n
    assert own(langid.predict(docs, lang)).count() == n
    for out in (langid.accept(docs, lang), neardup.drop_near_duplicates(docs), mixing.mixed(docs)):
        assert own(out).columns == docs.columns and out.count() > 0
    assert assign_shards(docs).count() == mixing.mix(docs).count() == neardup.near_duplicates(docs).count() == n


def test_rows_with_one_id_and_text_keep_what_else_they_hold(spark):
    rows = [(1, "same words here", lang, "s") for lang in ("en", "de", "fr", "en")] + [(i, f"words of number {i} and more", "en", "s") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = Counter(tuple(r) for r in mixing.mixed(docs).collect())
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    assert sum(v for k, v in out.items() if k[0] == 1) == taken[1] and set(out) == set(rows)  # one epoch at least of each, none instead of another
    assert all(1 <= v <= 2 * rows.count(k) for k, v in out.items())


def test_tables_go_when_they_are_swept(spark, tmp_path):
    sweep(spark)
    kept = materialize(spark.range(3), "mine")
    assert assign_shards(corpus.documents(spark)).count() > 0
    assert sweep(spark) == 2 and sweep(spark) == 0  # this one and the result's own
    with pytest.raises(Exception):
        kept.count()


def test_the_smallest_hashes(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id")
    want = sorted(r.h for r in df.collect())
    for n in (1, 100, 19_999, 30_000):
        assert sorted(r.h for r in smallest(df, "h", n, 20_000).collect()) == want[:n]
    assert sorted(r.h for r in smallest(df, "h", 100, 10**9).collect()) == want[:100]  # a wrong count costs a round, no rows
    assert smallest(df.where("false"), "h", 5, 0).count() == 0


# --- texts of several megabytes ---

SHARED = (700_000, 1_900_000)


@pytest.fixture(scope="module")
def long_docs(spark):
    """Two texts over 2 MB that share 1.2 MB across the borders of all pieces, one near copy, and a short one."""
    r = random.Random(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    \n", np.uint8)
    make = lambda n, s: letters[np.random.default_rng(s).integers(0, len(letters), n)].tobytes().decode()
    a = make(2_400_000, 1)
    b = make(300_000, 2) + a[slice(*SHARED)] + make(900_000, 3)
    words = a.split()
    words[r.randrange(len(words))] = "changed"
    rows = [(1, a, "en", "s"), (2, b, "en", "s"), (3, " ".join(words), "en", "s"), (4, "short text", "en", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).cache()


def test_long_texts_sizes_mix_and_quality(spark, long_docs):
    texts = {r.doc_id: r.text for r in long_docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in assign_shards(long_docs, 3).collect()} == {i: (len(t) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {r.doc_id: r["size"] for r in mixing.mix(long_docs).collect()} == {i: len(t.split()) for i, t in texts.items()}
    for r in quality.statistics(long_docs).collect():
        t, w = texts[r.doc_id], texts[r.doc_id].split()
        lines = [x for x in t.split("\n") if x.split()]
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_lines, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines), len(lines) - len(set(lines)), len(covered))


def test_long_texts_near_copies(spark, long_docs):
    sets = {r.doc_id: corpus.shingles(r.text) for r in long_docs.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(long_docs).collect()}
    assert got == {i: (len(s), {3: 1}.get(i, i)) for i, s in sets.items()}


def test_long_texts_decontamination_and_licences(spark, long_docs):
    a = long_docs.where("doc_id = 1").first().text
    words = corpus.LETTERED.findall(a)
    at = len(words) - 5000
    bench = spark.createDataFrame([(9, " ".join(words[at : at + 40])), (10, " ".join(words[at + 3 : at + 15]) + " other")], "item_id int, text string")
    got = {r.doc_id: r.contamination for r in contamination(long_docs, bench).collect()}
    assert got[1].n_hit == 40 and (got[1].longest, got[1].longest_word) == (40, at) and got[1]["items"] == ["10", "9"] and got[2].n_hit == got[4].n_hit == 0
    tail = spark.createDataFrame([(1, a + " released under the MIT License")], "doc_id int, text string")
    found = licences.scan(tail).first().licences
    assert found.base_labels == ["mit"] and found.n_words == len(words) + 5 and found.first_word == len(words) + 1


def test_long_texts_repeats(spark, long_docs):
    two = long_docs.where("doc_id in (1, 2, 4)")
    texts = {r.doc_id: r.text for r in two.collect()}
    a, b, (lo, hi) = texts[1], texts[2], SHARED
    left, right = lo, hi
    shift = b.index(a[lo : lo + 300]) - lo
    while a[left - 1] == b[left - 1 + shift]:
        left -= 1
    while a[right] == b[right + shift]:
        right += 1
    got = {r.doc_id: r.dedup for r in dedup_bytes(two).collect()}
    assert {i: (x.n_units, x.n_removed, x.n_spans) for i, x in got.items()} == {1: (len(a), right - left, 1), 2: (len(b), right - left, 1), 4: (10, 0, 0)}
    assert bytes(got[1].kept).decode() == a[:left] + a[right:]
    words, gone = [texts[i].split() for i in (1, 2)], corpus.windows_removed([texts[i].split() for i in (1, 2)], 35)
    got = {r.doc_id: r.dedup for r in dedup_words(two).collect()}
    for i, w, g in zip((1, 2), words, gone):
        assert got[i].n_removed == sum(g) and bytes(got[i].kept).decode() == " ".join(x for x, y in zip(w, g) if not y)


def test_long_texts_classifiers(spark, long_docs):
    model = langid.train(long_docs)
    assert {r.lang_pred for r in langid.predict(long_docs, model).collect()} == {"en"}
    out = rules.score(long_docs, rules.Ensemble(0.0, [((("n_words", True, 100_000.0),), 2.0)])).collect()
    assert {r.doc_id: r.predicted for r in out} == {1: 1, 2: 1, 3: 1, 4: 0}


def test_long_texts_pass_the_pipeline(spark, long_docs, sf):
    docs = long_docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        assert docs.count() >= 3, name


# --- the external sorter ---


def test_sorting_in_bounded_memory():
    """A text of many times the limit, with long repeats: queues spill, the recursion goes on, and memory stays far below what arrays of the whole would take."""
    rng = np.random.default_rng(1)
    piece = rng.integers(1, 60, 150_000).astype(np.uint16)
    text = np.concatenate([np.concatenate([rng.integers(1, 60, 50_000).astype(np.uint16), piece]) for _ in range(5)])
    log: dict = {}
    tracemalloc.start()
    n, last = 0, None
    for pos, lcp in descending(text, 128 << 10, base=1 << 10, log=log):
        n += len(pos)
        last = pos[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text) and last is not None and log["spilled"] > len(text) and len(log["levels"]) > 3
    assert peak < 24 * len(text)  # positions and ranks as whole arrays would take more than 60 bytes a character


@pytest.mark.parametrize("base", [0, 20, 3 << 20])
@pytest.mark.parametrize("seed", range(12))
def test_recursion_gives_order_and_common_prefixes(seed, base):
    rng = np.random.default_rng(seed)
    t = rng.integers(1, int(rng.integers(2, 30)), int(rng.integers(1, 300))).astype(np.uint16)
    t = np.concatenate([t, np.full(300 * (seed % 2), 3, np.uint16), t[: len(t) // 2], t])
    order, lcp = suffix_lcp(t, limit=[64, 512, 1 << 20][seed % 3], base=base, alphabet=[32, 2048][seed % 2])
    s = t.tolist()
    want = sorted(range(len(s)), key=lambda i: s[i:])
    assert order.tolist() == want
    for a, b, n in zip(want, want[1:], lcp[1:].tolist()):
        assert s[a : a + n] == s[b : b + n] and (n == 250 or s[a + n : a + n + 1] != s[b + n : b + n + 1])

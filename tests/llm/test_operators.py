"""Each operator against a brute-force version, on corpora with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import corpus
from tests.oracle import same
from tidemill.llm import langid, licences, mixing, neardup, queries, rules
from tidemill.llm.decontaminate import contamination, decontaminate, longest_matches
from tidemill.llm.neardup import drop_near_duplicates, near_duplicates
from tidemill.llm.quality import score
from tidemill.llm.sharding import assign_shards
from tidemill.llm.substrings import dedup_words
from tidemill.llm.suffixdedup import dedup_bytes


def empty(spark):
    return corpus.documents(spark).where("false")


def size(t):
    return len((t or "").encode()) + 16


# --- sharding ---


@pytest.mark.parametrize("n", [1, 7, 40])
def test_shards_are_balanced_and_contiguous(spark, n):
    docs = corpus.documents(spark)
    rows = assign_shards(docs, n).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    target, largest = sum(r.size for r in rows) / n, max(r.size for r in rows)
    for s, own in by.items():
        assert 0 <= s < n and sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - target) <= largest
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    start = 0
    for r in ordered:
        assert r.start == start
        start += r.size
    assert assign_shards(empty(spark), n).count() == 0


def test_a_group_with_most_rows_spans_shards(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(900)], "doc_id bigint, text string")
    got = assign_shards(docs, 9).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 9 and max(r.b for r in got) - min(r.b for r in got) <= 60


# --- mixing ---


def test_targets_reshare_the_excess():
    got = mixing.targets({"a": 100, "b": 10, "c": 1000, None: 0})
    left, free, want = 1.5 * 1110, {"a": 3, "b": 1, "c": 2, None: 3}, {}
    limits = {"a": 200, "b": 20, "c": 2000, None: 0}
    while free:
        unit = left / sum(free.values())
        over = [s for s in free if unit * free[s] >= limits[s]]
        if not over:
            want |= {s: unit * w for s, w in free.items()}
            break
        for s in over:
            want[s] = limits[s]
            left -= limits[s]
            del free[s]
    assert got == pytest.approx(want)


def test_mix_meets_its_targets_and_repeats(spark):
    docs = corpus.documents(spark, n=200)
    rows = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, len(corpus.SPACED.findall(r.text or ""))) for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    want = mixing.targets({s: sum(r["size"] for r in own) for s, own in by.items()})
    for s, own in by.items():
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sum(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r["size"] for r in own)
        assert {r.copies for r in own if r["size"]} <= {int(want[s] // own[0].source_size), int(want[s] // own[0].source_size) + 1}
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.taken, r.row_key) for r in rows) == Counter((r.doc_id, r.taken, r.row_key) for r in again)
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_better_documents_come_first(spark):
    docs = spark.createDataFrame([(i, ("word " * 50) + ("# " * 50 if i % 2 else ""), "s") for i in range(400)], "doc_id bigint, text string, source string")
    rows = mixing.mix(docs, share=0.5, limit=1.0).collect()
    good, bad = (sum(r.copies for r in rows if r.doc_id % 2 == k) for k in (0, 1))
    assert good > 2 * bad


# --- near duplicates ---


def components(rows, percent):
    sets = [corpus.shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i) if sets[i] else ("alone", r.doc_id)].append(r.doc_id)
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(r.doc_id, len(s), low[find(i) if s else ("alone", r.doc_id)]) for i, (r, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize(("seed", "percent", "crowd"), [(0, 85, 4096), (1, 80, 4096), (2, 85, 4)])
def test_near_duplicates(spark, seed, percent, crowd):
    docs = corpus.documents(spark, seed, 90)
    got = near_duplicates(docs, percent=percent, crowd=crowd).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(components(docs.collect(), percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_one_document_of_each_group_stays(spark):
    docs = corpus.documents(spark, 4, 90)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if corpus.shingles(r.text) and r.doc_id is not None]
    assert sorted(ids) == sorted({c for d, n, c in components(docs.collect(), 85) if n and d is not None})
    assert drop_near_duplicates(empty(spark)).count() == 0


def test_null_and_shared_ids_drop_no_unrelated_document(spark):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcdef")
    rows = [(None, a), (None, b), (None, c + " more"), (7, c), (8, c), (9, d), (9, e), (9, e), (None, f), (None, f + " more"), (None, f), (None, ""), (None, None), (3, " "), (3, " ")]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id bigint, text string, n int")
    for table in (docs, docs.repartition(3)):
        kept = Counter((r.doc_id, r.text) for r in drop_near_duplicates(table).collect())
        of_f = [x for x in kept.elements() if (x[1] or "").startswith("f0 ")]
        assert len(of_f) == 1 and of_f[0] in rows
        assert kept - Counter(of_f) == Counter([(None, a), (None, b), (7, c), (9, d), (9, e), (None, ""), (None, None), (3, " ")])
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect() if r.n_shingles)
    assert got == Counter({(None, None, True): 5, (None, 7, False): 1, (7, 7, True): 1, (8, 7, False): 1, (9, 9, True): 3})


def test_a_pair_at_the_threshold_with_few_shared_retained_values_is_linked(spark):
    words = [f"w{i}" for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(words)], names=["class", "text"])
    value = {i: int.from_bytes(s, "little") for b in neardup._full(1)(iter([batch])) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    words = [words[i] for i in sorted(value, key=value.get)]
    for percent, gone in ((85, 16), (85, 19), (80, 19), (80, 21)):  # 16, 13, 13 and 11 of 32 retained values shared
        part = words[:2] + words[2 + gone : 2 * percent + gone]
        docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(part))], "doc_id bigint, text string")
        assert len(part) == 2 * percent
        assert {r.component_id for r in near_duplicates(docs, percent=percent, width=1).collect()} == {1}


# --- SQL ---


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, sf, name):
    same(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])


# --- quality ---


def test_quality_of_awkward_rows(spark):
    docs = corpus.documents(spark)
    got = {(r.doc_id, r.text): r for r in score(docs).collect()}
    for (_, text), r in got.items():
        words = corpus.SPACED.findall(text or "")
        seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(words), len(covered), sum(map(len, words)))
        assert r.base_failed == (len(words) < 50 or 2 * len(covered) > len(words)) and not (r.base_failed and r.kept)
    assert score(empty(spark)).count() == 0 and got[0, docs.first().text].source == "s0"


# --- decontamination ---


def hits(docs, items, width=10):
    windows = defaultdict(set)
    for name, t in items:
        w = corpus.LETTERED.findall(corpus.lower(t or ""))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(name) if name is not None else None)
    out = []
    for d, t in docs:
        w, hit, found = corpus.LETTERED.findall(corpus.lower(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])] - {None}
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [32 << 20, 300])
def test_decontamination(spark, block_bytes):
    docs = corpus.documents(spark, 5)
    texts = [r.text for r in docs.collect()]
    items = [(i, " ".join((t or "").split()[3:40])) for i, t in enumerate(texts[:40:3])] + [(None, "no name at all"), (99, None), (100, "..."), (1, "ab ab"), (1, "ab ab")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination(docs, bench, block_bytes=block_bytes).collect()
    assert Counter((r.doc_id, r.contamination.n_words, r.contamination.n_hit, ",".join(r.contamination["items"])) for r in got) == hits([(r.doc_id, r.text) for r in docs.collect()], items)
    clean = decontaminate(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns and clean.count() == sum(1 for r in got if r.contamination.n_hit == 0)
    assert contamination(docs, bench.where("false")).where("contamination.n_hit > 0").count() == 0
    assert contamination(empty(spark), bench).count() == 0


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x one two three four y"), (2, "two three four five"), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "one two three four five")], "item_id bigint, text string")
    got = {r.item_word: (r.length, r.doc_id, r.doc_word) for r in longest_matches(docs, bench).collect()}
    assert got == {0: (4, 1, 1), 1: (4, 2, 0), 2: (3, 2, 1), 3: (2, 2, 2), 4: (1, 2, 3)}


# --- repeated passages ---


@pytest.mark.parametrize(("seed", "crowd"), [(0, 20_000), (1, 20_000), (2, 1)])
def test_byte_dedup(spark, seed, crowd):
    docs = corpus.documents(spark, seed)
    rows = docs.collect()
    raw = [(r.text or "").encode() for r in rows]
    want = Counter()
    for r, b, gone in zip(rows, raw, corpus.windows_removed(raw, 200)):
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[r.doc_id, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)] += 1
    got = dedup_bytes(docs, 200, crowd=crowd)
    assert got.columns == [*docs.columns, "dedup"]
    assert Counter((r.doc_id, r.dedup.n_units, r.dedup.n_removed, r.dedup.n_spans, bytes(r.dedup.kept)) for r in got.collect()) == want
    assert dedup_bytes(empty(spark)).count() == 0


@pytest.mark.parametrize(("seed", "crowd"), [(0, 20_000), (1, 20_000), (2, 1)])
def test_word_dedup(spark, seed, crowd):
    docs = corpus.documents(spark, seed)
    rows = docs.collect()
    words = [corpus.SPACED.findall(r.text or "") for r in rows]
    want = Counter((r.doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)) for r, w, gone in zip(rows, words, corpus.windows_removed(words, 35)))
    assert Counter((r.doc_id, r.dedup.n_units, r.dedup.n_removed, bytes(r.dedup.kept).decode()) for r in dedup_words(docs, 35, crowd=crowd).collect()) == want
    assert dedup_words(empty(spark)).count() == 0


# --- languages ---


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.fold("doc_id", 3) == 1
    model = langid.train(docs.where(~held))
    out = langid.predict(docs.where(held), model)
    wrong, n = out.where("lang != lang_pred").count(), out.count()
    assert n > 200 and wrong <= 0.02 * n
    odd = {r.text: (r.lang_pred, r.score) for r in langid.predict(corpus.documents(spark), model).collect()}
    assert odd[None] == odd[""] == odd["!!! ..."] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in odd.values())
    assert langid.predict(corpus.documents(spark), None).where("lang_pred != 'und'").count() == 0
    assert langid.train(docs.where("false")) is None and langid.predict(empty(spark), model).count() == 0
    assert (model.weights == 0).mean() > 0.1  # the penalty leaves gaps


def test_rare_languages_are_known_to_the_model(spark):
    greek = ["η γλώσσα αυτή είναι σπάνια εδώ", "μια γλώσσα που είναι σπάνια", "και αυτή η γλώσσα είναι εδώ", "εδώ είναι η σπάνια γλώσσα"]
    plain = [(i, f"some words of a common language {i} and nothing else here", "en") for i in range(1500)]
    plain += [(i, f"viele wörter einer anderen sprache {i} und sonst nichts hier", "de") for i in range(1500, 3000)]
    docs = spark.createDataFrame(plain + [(5000 + i, t, "el") for i, t in enumerate(greek)], "doc_id bigint, text string, lang string")
    model = langid.train(docs, max_rows=60)
    assert model.langs == ["de", "el", "en"]
    assert langid.predict(docs, model).where("lang != lang_pred").count() == 0
    assert langid.accept(docs, model).where("lang = 'el'").count() == 4


def test_without_labels_lettered_documents_stay(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "éß", None), (3, "12 ...", None), (4, "", None), (5, None, None), (6, "漢字", None)], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in langid.accept(docs, langid.train(docs)).collect()} == {1, 2, 6}


# --- licences ---


def test_licence_places_and_labels(spark):
    notes = [
        "Released under the MIT License. And again UNDER THE MIT LICENSE",
        "x, Licensed under the Apache License, Version 2.0!",
        "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "mit license apache public version",
        *corpus.texts(1, 10),
    ]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(notes)], "doc_id bigint, text string, licences string")
    got = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
    for i, t in enumerate(notes):
        words, places, labels = corpus.LETTERED.findall(corpus.lower(t or "")), [], set()
        for phrase, label in licences.PHRASES.items():
            p = phrase.split()
            own = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == sorted(labels) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert [got[i].labels for i in range(6)] == [["mit"], ["apache-2"], ["cc-by-nc"], ["gpl-3"], ["mit"], []]
    assert licences.scan(empty(spark)).count() == 0


def test_all_notices_of_one_text_are_found(spark):
    notices = [notice for _, notice, _ in licences.TEMPLATES]
    texts = [" . filler . ".join(notices), " . filler . ".join(reversed(notices)), *notices, *[" ".join(notices[i : i + 4]) for i in range(5)]]
    want = [{label for label, notice, _ in licences.TEMPLATES if notice in t} for t in texts]
    for also in ([], ["permission mozilla redistribution gnu"] * 30):  # whatever words are the rarest
        docs = spark.createDataFrame(list(enumerate(texts + also)), "doc_id bigint, text string")
        got = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
        assert all(w <= set(got[i].labels) for i, w in enumerate(want))
        assert set(got[0].labels) == set(got[1].labels) == want[0] == {label for label, _, _ in licences.TEMPLATES}


# --- quality classifier ---


def test_quality_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = langid.fold("doc_id", 4) == 2
    model = rules.train(docs, labels.where(~held))
    out = rules.score(docs.join(labels, "doc_id").where(held), model)
    n = out.count()
    assert n > 50 and out.where("predicted = quality").count() >= 0.95 * n
    got = rules.score(corpus.documents(spark), model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got) and {r.n_words for r in got} >= {0, 1}
    assert rules.score(empty(spark), model).count() == 0
    assert rules.train(docs, labels.where("false")).rules == []


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")

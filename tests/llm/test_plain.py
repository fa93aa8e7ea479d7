"""Operators and their parts against plain versions, row by row."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import corpus
from tests.llm.test_operators import components
from tidemill.llm import langid, licences, neardup, rules
from tidemill.llm.decontaminate import contamination, longest_matches
from tidemill.llm.flat import Sequence, U, mix
from tidemill.llm.substrings import internal_nodes, leaves, repeated_starts

# --- near duplicates ---


def test_union_sketches_estimate_the_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.5, 0.7, 0.85):
        got = []
        for _ in range(60):
            n = 2000
            both = int(2 * n * share / (1 + share))
            pool = np.unique(mix(rng.integers(0, 1 << 62, 2 * n + 50).astype(U)))
            rng.shuffle(pool)
            a, b = np.sort(pool[:n])[:32], np.sort(pool[n - both : 2 * n - both])[:32]
            union = set(np.sort(np.union1d(a, b))[:32].tolist())
            shared = neardup._union_sketch(a, b[None, :], 32)[0]
            assert shared == len(union & set(a.tolist()) & set(b.tolist()))
            got.append(shared / 32)
        assert abs(np.mean(got) - share) < 0.05


def test_estimates_of_short_sets_are_exact():
    r = random.Random(2)
    for _ in range(200):
        sets = [np.array(sorted(r.sample(range(1, 40), r.randint(1, 12))), U) for _ in range(4)]
        label = neardup._estimated_groups(sets, 32, 13)
        for i in range(4):
            for j in range(i):
                both, union = len(set(sets[i].tolist()) & set(sets[j].tolist())), len(set(sets[i].tolist()) | set(sets[j].tolist()))
                assert label[i] == label[j] or 32 * both < 13 * min(32, union)


@pytest.mark.parametrize("percent", [80, 85])
def test_all_links_of_many_documents(spark, percent):
    """Near copies with similarities all around the threshold: every link that brute force finds is found."""
    r = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(120):
        words = [r.choice(vocabulary) for _ in range(r.choice([20, 60, 150, 400]))]
        for _ in range(5):
            copy = list(words)
            for _ in range(int(len(copy) * r.uniform(0.0, 0.06)) + r.randint(0, 1)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in neardup.near_duplicates(docs, percent=percent).collect())
    assert got == Counter(components(docs.collect(), percent))


# --- decontamination ---


def test_longest_matches_by_brute_force(spark):
    docs = corpus.documents(spark, 9)
    texts = [r.text for r in docs.collect()]
    items = [(i, " ".join((t or "").split()[3:60])) for i, t in enumerate(texts[:40:3])] + [(50, "ab ab ab")]
    benches = [corpus.LETTERED.findall(corpus.lower(t)) for _, t in items]
    for blocks in (32 << 20, 400):
        got = contamination(docs, spark.createDataFrame(items, "item_id int, text string"), block_bytes=blocks).collect()
        for r in got:
            w, best = corpus.LETTERED.findall(corpus.lower(r.text or "")), (0, None)
            for b in benches:
                need = min(10, len(b))
                for i in range(len(w)):
                    for j in range(len(b)) if need == 10 else [0]:
                        n = 0
                        while need and i + n < len(w) and j + n < len(b) and w[i + n] == b[j + n]:
                            n += 1
                        if need and n >= need and (n, -i) > (best[0], -(best[1] or 0)):
                            best = (n, i)
            assert (r.contamination.longest, r.contamination.longest_word) == best


def test_longest_matches_of_ids_that_are_text(spark):
    docs = spark.createDataFrame([("doc-a", "x one two three four y"), ("doc-b", "two three four five")], "doc_id string, text string")
    bench = spark.createDataFrame([("q", "one two three four five")], "item_id string, text string")
    got = {r.item_word: (r.length, r.doc_id, r.doc_word) for r in longest_matches(docs, bench).collect()}
    assert got[0] == (4, "doc-a", 1) and got[1] == (4, "doc-b", 0)


def test_common_prefixes_by_hashes():
    rng = np.random.default_rng(3)
    w = mix(rng.integers(0, 3, 300).astype(U))
    seq = Sequence(w, 300 - np.arange(300))
    a, b = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    want = [next((k for k in range(300) if i + k >= 300 or j + k >= 300 or w[i + k] != w[j + k]), 300) for i, j in zip(a.tolist(), b.tolist())]
    assert seq.common(a, seq, b).tolist() == want


# --- suffix trees ---


@pytest.mark.parametrize("seed", range(6))
def test_trees_branch_where_suffixes_differ(seed):
    rng = np.random.default_rng(seed)
    words = mix(rng.integers(1, 4, 120).astype(U))
    stop = np.full(100, 120)
    pos, branch = leaves(words, np.arange(100), stop, np.zeros(100, np.int64), 0)
    s = words.tolist()
    for x, y, d in zip(pos.tolist(), pos[1:].tolist(), branch[1:].tolist()):
        assert s[x : x + d] == s[y : y + d] and (max(x, y) + d >= 120 or s[x + d] != s[y + d])
    nodes = internal_nodes(branch, 2)
    seen = set()
    for depth, lo, hi in zip(nodes.depth.tolist(), nodes.lo.tolist(), nodes.hi.tolist()):
        own = [tuple(s[p : p + depth]) for p in pos[lo:hi].tolist()]
        assert len(own) > 1 and len(set(own)) == 1 and own[0] not in seen  # a node is one string, with all its places
        assert sum(tuple(s[p : p + depth]) == own[0] for p in range(100)) == len(own)
        seen.add(own[0])


@pytest.mark.parametrize("seed", range(8))
def test_repeated_starts_of_trees(seed):
    r = random.Random(seed)
    width = 5
    rows = [[r.choice("abc") for _ in range(r.randint(width, 40))] for _ in range(6)]
    weight = np.array([r.choice([1, 1, 2]) for _ in rows])
    words = mix(np.array([ord(x) for row in rows for x in row], np.int64).astype(U))
    first = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    count = np.array([len(x) - width + 1 for x in rows])
    seen = Counter()
    for row, n in zip(rows, weight.tolist()):
        for i in range(len(row) - width + 1):
            seen[tuple(row[i : i + width])] += n
    want = [i + width <= len(row) and seen[tuple(row[i : i + width])] > 1 for row in rows for i in range(len(row))]
    assert repeated_starts(width)(words, first, count, weight).tolist() == want


# --- languages ---


def plain_grams(text):
    """Buckets of 1-, 2- and 3-grams, one code point after another."""
    m = 0xFFFFFFFF
    c = [ord(x.lower()) if x.isalpha() and len(x.lower()) == 1 else ord(x) if x.isalpha() else 32 for x in text]
    out = []
    for i in range(len(c)):
        a, b, d = c[i], (c[i + 1] if i + 1 < len(c) else 32), (c[i + 2] if i + 2 < len(c) else 32)
        one = a * 0x9E3779B1 & m
        two = ((one ^ one >> 15) * 0x85EBCA77 + b * 0xC2B2AE3D) & m
        three = ((two ^ two >> 13) * 0x27D4EB2F + d * 0x165667B1) & m
        base = 0
        for h, dim in zip((one, two, three), langid.DIMS):
            h = (h ^ h >> 16) * 0x7FEB352D & m
            out.append((h >> 16) % dim + base)
            base += dim
    return out


def test_predictions_are_those_of_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs, max_rows=120)
    rows = corpus.documents(spark, 3).select("doc_id", "text")
    for r in langid.predict(rows, model).collect():
        if not any(x.isalpha() for x in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        grams = plain_grams(r.text)
        z = [sum(model.weights[g, k] for g in grams) / len(grams) + model.bias[k] for k in range(len(model.langs))]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        assert r.score == pytest.approx(max(e) / sum(e), rel=1e-3) and r.lang_pred == model.langs[int(np.argmax(z))]


def test_document_frequencies_cover_all_rows(spark):
    docs = spark.createDataFrame([(i, "aa b" if i % 2 else "b", "x") for i in range(500)], "doc_id long, text string, lang string")
    got = {r.id: r.n for r in docs.select("text").mapInArrow(langid._frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    want = Counter(g for i in range(500) for g in set(plain_grams("aa b" if i % 2 else "b")))
    assert got == {-1: 500, **want}


def test_ftrl_is_its_formula():
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(40)]
    y = rng.integers(0, 3, 40)
    got = langid.ftrl(rows, y, 3, 12, epochs=2)
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, k):
        if abs(z[i][k]) <= 0.01:
            return 0.0
        return -(z[i][k] - math.copysign(0.01, z[i][k])) / ((1.0 + math.sqrt(n[i][k])) / 0.5 + 0.01)

    for epoch in range(2):
        for t in np.random.default_rng(epoch).permutation(40):
            ids, x = rows[t]
            w = [[weight(i, k) for k in range(3)] for i in ids]
            s = [sum(x[j] * w[j][k] for j in range(4)) for k in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            for j, i in enumerate(ids):
                for k in range(3):
                    g = (e[k] / sum(e) - (k == y[t])) * x[j]
                    z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / 0.5 * w[j][k]
                    n[i][k] += g * g
    assert got == pytest.approx(np.array([[weight(i, k) for k in range(3)] for i in range(12)]), rel=1e-9, abs=1e-12)


# --- licences ---


def test_labels_and_scores_of_a_plain_scan(spark):
    r = random.Random(8)
    notices = [n for _, n, _ in licences.TEMPLATES]
    texts = []
    for _ in range(60):
        words = " ".join(r.choice(notices) for _ in range(r.randint(0, 3))).split()
        for _ in range(r.randint(0, 6)):
            if words:
                words[r.randrange(len(words))] = r.choice(["other", "license", "public", "version", ""])
        texts.append("Some, words; ".join([" ".join(words), ""]) + " end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idx = licences.index(*licences.frequencies(docs))
    posts = Counter(t for _, _, ps in idx for t, _ in ps)
    for row in licences.scan(docs).collect():
        w = corpus.LETTERED.findall(corpus.lower(texts[row.doc_id]))
        share = Counter()
        for word, _, ps in idx:
            for t, p in ps:
                for i, x in enumerate(w):
                    if x == word:
                        share[t, i - p] += 1
        labels, best = set(row.licences.base_labels), 1.0 if row.licences.n_base else 0.0
        for (t, s), n in share.items():
            label, notice, key = licences.TEMPLATES[t]
            k, words = key.split(), notice.split()
            at = s + next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            if n / posts[t] >= 0.6 and at >= 0 and w[at : at + len(k)] == k:
                labels.add(label)
                best = max(best, n / posts[t])
        assert row.licences.labels == sorted(labels) and row.licences.score == pytest.approx(best)


# --- rules ---


def test_compiled_rules_are_the_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = rules.train(docs, labels)
    assert model.rules
    rows = rules.features(docs.limit(300)).collect()
    scores = {r.doc_id: r.score for r in rules.score(docs, model).collect()}
    for r in rows:
        z = model.bias + sum(w for rule, w in model.rules if all((r[f"_f_{n}"] > t) == above for n, above, t in rule))
        assert scores[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(4)
    a = (rng.random((400, 12)) > 0.5).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * a[:, 0] - 2 * a[:, 1])))).astype(float)
    b, w = rules._lasso(a, y, 0.02, steps=4000)
    g = a.T @ (1 / (1 + np.exp(-(a @ w + b))) - y) / 400
    assert np.all(np.abs(g[w == 0]) <= 0.02 + 1e-4) and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-3) and (w == 0).any() and w[0] > 0 > w[1]


def test_conditions_on_results_do_not_reach_into_lambdas(spark):
    """An optimizer that moved a condition on a result below its projection would compute arrays again for each element."""
    docs = corpus.documents(spark).select("doc_id", "text")
    model = rules.Ensemble(0.0, [((("repeats", True, 0.2),), 1.0)])
    plan = rules.score(docs, model).where("score > 0.5").select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") <= 4 and "monotonically_increasing_id" in plan

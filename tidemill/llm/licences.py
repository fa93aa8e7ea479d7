"""Licence scans by a positional rare-token index, in DataFrame expressions only.

Templates are short notices. Document frequencies of their words are counted over all documents; each template is indexed by
its rarest words, each with its positions in the template. For a file, all of its indexed words are looked up; every
occurrence votes for (template, place where the template would start); places with enough votes are verified by the template's
mandatory key phrase, word by word. The index is a fixed set of literals, so there is no join and no shuffle besides the one that counts
frequencies (one row a licence word).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import opaque

#: Runs of characters that are no words, before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose places count, with their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, notice, mandatory key phrase (part of the notice). Openings of public licence notices.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl-2", "gnu general public license version 2", "public license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)


def _words(t: Column) -> Column:
    return F.array_remove(F.split(t, SEPARATORS), "")


def _lower(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(w, UPPER, LOWER))


def _starts(words: Column, phrase: list[str]) -> Column:
    """Word positions at which the phrase's words stand consecutively."""
    fits = lambda w, i: F.when(w == phrase[0], _all(F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(phrase))).otherwise(False)
    at = F.filter(F.transform(words, lambda w, i: F.when(fits(w, i), i)), lambda i: i.isNotNull())
    return F.when(_all(F.array_contains(words, p) for p in dict.fromkeys(phrase)), at).otherwise(F.array().cast("array<int>"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def frequencies(docs: DataFrame, text: str = "text", templates: tuple = TEMPLATES) -> tuple[int, dict[str, int]]:
    """The number of documents, and in how many of them each template word occurs (all documents, whole texts)."""
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()})
    words = _lower(_words(F.coalesce(F.col(text), F.lit(""))))
    seen = docs.select(F.explode(F.array_append(F.array_intersect(words, F.array(*map(F.lit, vocabulary))), "")).alias("w"))
    got = {r[0]: r[1] for r in seen.groupBy("w").count().collect()}  # one row a licence word; "" counts the documents
    return got.get("", 0), {w: got.get(w, 0) for w in vocabulary}


def index(n: int, df: dict[str, int], rarest: int = 3, templates: tuple = TEMPLATES) -> list[tuple[str, float, list[tuple[int, int]]]]:
    """(word, idf, postings as (template, position)) for the rarest words of each template, rarest first; ties by the word."""
    idf = {w: math.log((n + 1) / (c + 1)) for w, c in df.items()}
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (_, notice, _) in enumerate(templates):
        words = notice.split()
        for w in sorted(set(words), key=lambda w: (-idf[w], w))[:rarest]:
            postings.setdefault(w, []).extend((t, p) for p, x in enumerate(words) if x == w)
    return sorted(((w, idf[w], p) for w, p in postings.items()), key=lambda x: (-x[1], x[0]))


def scan(docs: DataFrame, text: str = "text", rarest: int = 3, least: float = 0.6, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """docs with the struct `licences`: n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays), score.

    least: the share of a template's indexed positions that must agree on one place. score is the best verified share, 1 where a
    base phrase stands, 0 without a label. A null text counts as empty: no words, no places (first and last are null). An existing column
    `licences` is replaced, others stay; repeated rows are scanned each; an empty table stays empty.
    """
    idx = index(*frequencies(docs, text, templates), rarest=rarest, templates=templates)
    needed = {t: sum(t == x for _, _, ps in idx for x, _ in ps) for t in range(len(templates))}
    keep = [c for c in docs.columns if c != "licences"]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("_row"), _lower(_words(t)).alias("_w"))
    # every array that a lambda reads is a column first: inside the lambda it would be computed once for each element
    rows = rows.select("*", F.size("_w").alias("_n"), F.array_intersect(F.array(*[F.lit(w) for w, _, _ in idx]).cast("array<string>"), F.col("_w")).alias("_own"))
    near = F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("_own", x["w"]))
    none = F.array().cast("array<struct<w:string,i:int>>")
    rows = rows.select("*", *[_starts(F.col("_w"), p.split()).alias(f"_b{i}") for i, p in enumerate(phrases)], F.when(F.size("_own") > 0, near).otherwise(none).alias("_near"))
    rows = rows.withColumn("_votes", F.array_distinct(_votes(idx)))
    # the share of a template's indexed positions that agree on a place
    rows = rows.withColumn("_places", F.filter(F.transform("_votes", lambda v: F.struct(v["t"].alias("t"), v["s"].alias("s"), _share(v, idx, needed).alias("share"))), lambda v: v["share"] >= least))
    verified = F.filter("_places", lambda v: _verify(v, templates))
    rows = rows.withColumn("_found", opaque(verified))
    label = F.array(*[F.lit(x) for x, _, _ in templates])
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"_b{i}") > 0, F.lit(x)) for i, x in enumerate(phrases.values())]), lambda x: x.isNotNull())))
    places = F.concat(*[F.col(f"_b{i}") for i in range(len(phrases))])
    best = F.coalesce(F.array_max(F.transform("_found", lambda v: v["share"])), F.lit(0.0))
    found = rows.select(
        "_row",
        F.struct(
            F.col("_n").cast("long").alias("n_words"),
            F.size(places).cast("long").alias("n_base"),
            F.array_min(places).cast("long").alias("first_word"),
            F.array_max(places).cast("long").alias("last_word"),
            base.alias("base_labels"),
            F.array_sort(F.array_union(base, F.array_distinct(F.transform("_found", lambda v: F.get(label, v["t"]))))).alias("labels"),
            F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.least(best, F.lit(1.0))).alias("score"),
        ).alias("licences"),
    )
    return found.select("_row.*", "licences")


def _votes(idx: list) -> Column:
    """(template, start) for each occurrence of the file's indexed words."""
    if not idx:
        return F.array().cast("array<struct<t:int,s:int>>")
    entries = F.create_map(*[x for w, _, ps in idx for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]))])
    return F.flatten(F.transform("_near", lambda x: F.transform(entries[x["w"]], lambda e: F.struct(e["t"].alias("t"), (x["i"] - e["p"]).alias("s")))))


def _share(v: Column, idx: list, needed: dict[int, int]) -> Column:
    """How many of the template's indexed positions hold their word if the template starts there, of all: the postings that meet at this place."""
    out = F.lit(0.0)
    for k, n in needed.items():
        agree = F.lit(0)
        for w, _, ps in idx:
            for x, p in ps:
                if x == k:
                    agree = agree + F.when(F.get(F.col("_w"), v["s"] + p) == w, 1).otherwise(0)
        out = F.when(v["t"] == k, agree / max(1, n)).otherwise(out)
    return out


def _verify(v: Column, templates: tuple) -> Column:
    """Whether the key phrase of the place's template stands where the place puts it."""
    out = F.lit(False)
    for t, (_, notice, key) in enumerate(templates):
        words, k = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        out = out | ((v["t"] == t) & _all(F.coalesce(F.get(F.col("_w"), v["s"] + at + j) == w, F.lit(False)) for j, w in enumerate(k)))
    return out

"""Small corpora with every kind of awkward row, and plain versions of the operators' rules."""

import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def texts(seed=0, n=60):
    """Prose of invented words, with exact copies, near copies, shared passages, repeated runs, odd characters, empties and nulls."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 30, 80, 200]))]
        kind = r.random()
        if out and kind < 0.2:
            out.append(r.choice(out))
            continue
        if out and kind < 0.4:
            words = (r.choice(out) or "x").split()
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        elif kind < 0.5:
            words[r.randrange(len(words)) : 0] = passage.split()
        elif kind < 0.55:
            words = ["ab", "ab"] * 60
        out.append("".join(w + r.choice([" ", " ", "\n", "\t ", "  "]) for w in words))
    return [*out, None, "", "   ", "!!! ...", "a" * 700, "Ünï çödé 漢字 " * 40, None, out[0], out[0]]


def documents(spark, seed=0, n=60):
    """doc_id, text, lang, source, n_chars and columns whose names operators use themselves; a repeated row and a null in every column."""
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s0", "s1", "é", None][i % 6], len(t or ""), i, "k", 0.5, i % 2) for i, t in enumerate(texts(seed, n))]
    rows += [rows[0], rows[5], (None, "no id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, k string, score double, shard int")


def windows_removed(units, width):
    """For each list of units, which are covered by a window that also starts elsewhere."""
    from collections import Counter

    seen = Counter(tuple(u[i : i + width]) for u in units for i in range(len(u) - width + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if seen[tuple(u[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def shingles(t, width=5):
    w = SPACED.findall(lower(t or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

"""Quality classifier as a sparse rule ensemble, compiled into Spark column expressions.

Boosted shallow trees over statistics of whole texts give conjunctive rules (every path from a root), a lasso logistic regression
gives them weights, most of them zero, and the rest compile into one Spark column. Training reads a bounded sample of labelled rows; scoring is
a projection over all documents, without shuffles or user functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import statistics
from .shared import opaque, smallest

#: feature: expression over quality.statistics()
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "if(n_words > 0, word_chars / n_words, 0D)",
    "symbols": "if(n_words > 0, n_symbols / n_words, 0D)",
    "dup_lines": "if(n_lines > 0, n_dup_lines / n_lines, 0D)",
    "repeats": "if(n_words > 0, n_repeat_words / n_words, 0D)",
    "stop_words": "if(n_words > 0, n_stop_words / n_words, 0D)",
    "upper": "if(word_chars > 0, n_upper / word_chars, 0D)",
    "line_words": "if(n_lines > 0, n_words / n_lines, 0D)",
}
Rule = tuple[tuple[str, bool, float], ...]  # (feature, above, threshold) each; all must hold


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """The probability of label 1 as a column over features()."""
        z = F.lit(self.bias)
        for rule, w in self.rules:
            holds = F.lit(True)
            for name, above, t in rule:
                holds = holds & ((F.col(f"_f_{name}") > t) if above else (F.col(f"_f_{name}") <= t))
            z = z + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """statistics() with a column _f_<name> for each feature."""
    return statistics(docs, text).select("*", *[opaque(F.expr(e)).alias(f"_f_{n}") for n, e in FEATURES.items()])


def _tree(x: np.ndarray, r: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: Rule, names: list[str], out: list[Rule], fit: np.ndarray) -> None:
    """Split greedily by squared error; every path below the root is a rule."""
    fit[rows] = r[rows].mean()
    if path:
        out.append(path)
    if depth == 0 or len(rows) < 2 * least:
        return
    best = (1e-9, -1, 0.0)
    total, n = r[rows].sum(), len(rows)
    for f, ts in enumerate(cuts):
        v = x[rows, f]
        for t in ts:
            m = v > t
            k = int(m.sum())
            if least <= k <= n - least:
                a = r[rows][m].sum()
                gain = a * a / k + (total - a) ** 2 / (n - k) - total * total / n
                if gain > best[0]:
                    best = (gain, f, float(t))
    if best[1] < 0:
        return
    m = x[rows, best[1]] > best[2]
    for above in (False, True):
        _tree(x, r, rows[m == above], cuts, depth - 1, least, (*path, (names[best[1]], above, best[2])), names, out, fit)


def _lasso(a: np.ndarray, y: np.ndarray, l1: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient."""
    n, m = a.shape
    rate = 4 * n / (np.linalg.norm(a, 2) ** 2 + n)
    w, b, v, c, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(a @ v + c))) - y
        w2 = v - rate * (a.T @ e) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * l1, 0)
        b2 = c - rate * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 12, depth: int = 3, l1: float = 0.0015, seed: int = 3) -> Ensemble:
    """Rules from gradient-boosted trees on random halves, then lasso weights. One class only: a constant score."""
    share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
    if len(y) < 20 or y.min() == y.max():
        return Ensemble(float(np.log(share / (1 - share))), [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))) for f in range(x.shape[1])]
    rng, rules, margin = np.random.default_rng(seed), [], np.full(len(y), np.log(share / (1 - share)))
    for _ in range(trees):
        r = y - 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        rows = np.sort(rng.choice(len(y), max(20, len(y) // 2), replace=False))
        found: list[Rule] = []
        _tree(x, r, rows, cuts, depth, max(5, len(y) // 200), (), names, found, step)
        rules += found
        margin += 1.0 * step * 4
    rules = list(dict.fromkeys(rules))
    at = {n: i for i, n in enumerate(names)}
    a = np.ones((len(y), len(rules)))
    for j, rule in enumerate(rules):
        for name, above, t in rule:
            a[:, j] *= (x[:, at[name]] > t) == above
    bias, w = _lasso(a, y.astype(float), l1)
    return Ensemble(bias, [(rule, round(float(v), 6)) for rule, v in zip(rules, w, strict=True) if abs(v) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = 8000, seed: int = 3) -> Ensemble:
    """Fit on the labelled documents with the max_rows smallest hashes of their id (a documented bound).

    Labels that are null count as missing; several labels of one id count as their highest; ids without a document are not used.
    """
    chosen = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("double").alias("_y"))
    chosen = smallest(chosen.withColumn("_h", F.xxhash64(F.lit(seed), "_id")), "_h", max_rows, chosen.count()).drop("_h")  # max_rows narrow rows: small enough to broadcast
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    names = list(FEATURES)
    got = features(rows, "_text").groupBy("_id").agg(F.min(F.struct(*[f"_f_{n}" for n in names])).alias("f"), F.first("_y").alias("_y")).select("_id", "f.*", "_y").toArrow().sort_by("_id")
    x = np.stack([got[f"_f_{n}"].to_numpy() for n in names], 1) if len(got) else np.zeros((0, len(names)))
    return fit(x, got["_y"].to_numpy() >= 0.5, names)


def score(docs: DataFrame, model: Ensemble, text: str = "text", at: float = 0.7, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the score and 1 or 0 for a score of `at` or more. Null and empty texts are scored by their zero statistics; equal texts score alike; columns named as in `into` are replaced, others stay, whatever their names; a
    text is scored whole, however long; an empty table stays empty."""
    keep = [c for c in docs.columns if c not in into]
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(text).alias("_text"))  # names of docs cannot clash with statistics
    scored = features(rows, "_text").withColumn(into[0], model.score())
    return scored.select("_row.*", into[0], (F.col(into[0]) >= at).cast("int").alias(into[1]))

"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed 1- to 3-grams of lower-cased letters (everything else counts as a blank), weighted by relative term
frequency times inverse document frequency. Document frequencies are counted over all documents of the learning folds;
the regression is fitted by follow-the-regularised-leader with L1 and L2 penalties on a bounded sample of them, in part held
back for temperature calibration. Prediction gathers weights over whole texts in one scan, with no shuffle.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import chunks
from .shared import smallest, tidy

#: Buckets of the 1-, 2- and 3-grams.
DIMS = (1 << 10, 1 << 12, 1 << 14)
D = sum(DIMS)
PIECE = 1 << 20  # bytes of text in work at once


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower case (a blank where it is none)."""
    alpha = np.array([chr(i).isalpha() for i in range(0x110000)])
    lower = np.full(0x110000, 0x20, np.uint32)
    for i in np.flatnonzero(alpha).tolist():
        x = chr(i).lower()
        lower[i] = ord(x) if len(x) == 1 else i
    return alpha, lower


def _points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk, and the offsets of its rows in them. Bytes that are no UTF-8 count as replacement characters."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(cps) == lead[-1]:
        return cps, lead[at]
    texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each code point (n = 1, 2, 3; blanks follow a row's end), row offsets, letters by row."""
    alpha, lower = _letters()
    cps, first = _points(data, at)
    c = lower[cps]
    inside = np.concatenate([[0], np.cumsum(alpha[cps])])
    n = len(c)
    nxt = np.concatenate([c[1:], np.full(1, 0x20, np.uint32)]) if n else c
    ends = first[1:][first[1:] > 0] - 1
    nxt[ends] = 0x20
    after = np.concatenate([nxt[1:], np.full(1, 0x20, np.uint32)]) if n else c
    after[ends] = 0x20
    one = c * np.uint32(0x9E3779B1)
    two = (one ^ (one >> np.uint32(15))) * np.uint32(0x85EBCA77) + nxt * np.uint32(0xC2B2AE3D)
    three = (two ^ (two >> np.uint32(13))) * np.uint32(0x27D4EB2F) + after * np.uint32(0x165667B1)
    out, base = [], 0
    for h, dim in zip((one, two, three), DIMS, strict=True):
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
        out.append(((h >> np.uint32(16)) % np.uint32(dim)).astype(np.int32) + base)
        base += dim
    return out, first, inside[first[1:]] - inside[first[:-1]]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (D, languages), times idf and scale already
    bias: np.ndarray
    temperature: float


def _counts(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts of each row."""
    grams, first, _ = _grams(data, at)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = sum(np.bincount(g[a:b], minlength=D) for g in grams)
        ids = np.flatnonzero(n)
        yield ids, n[ids]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(D, np.int64), 0
    for batch in batches:
        for part, data, at in chunks(batch, "text", PIECE):
            for ids, _ in _counts(data, at):
                total[ids] += 1
            rows += part.num_rows
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], ids]).astype(np.int64)), pa.array(np.concatenate([[rows], total[ids]]))], names=["id", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in chunks(batch, "text", PIECE):
            got = list(_counts(data, at))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.astype(np.int32).tobytes() for i, _ in got]), pa.array([n.astype(np.int32).tobytes() for _, n in got])], names=["lang", "ids", "counts"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, dims: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, epochs: int = 4) -> np.ndarray:
    """Weights (dims, classes) by FTRL-proximal: per coordinate rates, an L1 threshold that keeps them sparse, an L2 penalty."""
    z, n = np.zeros((dims, classes)), np.zeros((dims, classes))

    def weights(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            ids, x = rows[i]
            w = weights(ids)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            old = n[ids]
            n[ids] = old + g * g
            z[ids] += g - (np.sqrt(n[ids]) - np.sqrt(old)) / alpha * w
    return weights(np.arange(dims))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: tuple[str, ...] = ("doc_id",), max_rows: int = 3000, seed: int = 5, minimum: int = 50) -> Model | None:
    """A model of docs (the learning folds), or None without labelled rows.

    Document frequencies cover every labelled row. The regression and the temperature are fitted on the max_rows rows with the smallest hash
    of `order` and the text (one in five of them for the temperature): a documented bound; repeated rows count once there. The hashes are chosen first, from narrow rows, and
    only then the texts. Languages are counted over all labelled rows; one with fewer
    than `minimum` rows in that sample gets its own rows with the smallest hash besides, up to `minimum`, so that none is unknown to the model.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(seed), *[F.col(c) for c in order], F.col(text)).alias("h"))
    df = np.zeros(D + 1, np.int64)
    for i, n in rows.select("text").mapInArrow(tidy(_frequencies), "id long, n long").groupBy("id").agg(F.sum("n")).collect():  # D + 1 rows at most
        df[i] = n  # -1: the number of documents
    if not df[-1]:
        return None
    features = lambda some: some.select("lang", "text").mapInArrow(tidy(_features), "lang string, ids binary, counts binary").toArrow()
    sample = features(smallest(rows, "h", max_rows, int(df[-1])).dropDuplicates(["h", "lang"]).orderBy("h", "lang"))
    seen = Counter(sample["lang"].to_pylist())
    langs = sorted(r[0] for r in rows.groupBy("lang").count().collect())  # one row a language
    rare = [x for x in langs if seen[x] < minimum]
    if rare and df[-1] > max_rows:
        own = rows.where(F.col("lang").isin(rare))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        cuts = own.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= minimum).groupBy("lang").agg(F.max("h").alias("cut"))
        more = features(own.join(F.broadcast(cuts), "lang").where("h <= cut").dropDuplicates(["lang", "h"]).orderBy("lang", "h"))
        common = sample.filter(pc.invert(pc.is_in(sample["lang"], pa.array(rare, pa.string()))))  # what it holds of the rare ones comes again
        sample = pa.concat_tables([common, more])
    names = sample["lang"].to_pylist()
    idf = np.log((df[-1] + 1) / (df[:D] + 1)) + 1
    data = []
    for ids, counts in zip(sample["ids"].to_pylist(), sample["counts"].to_pylist(), strict=True):
        i, c = np.frombuffer(ids, np.int32).astype(np.int64), np.frombuffer(counts, np.int32)
        data.append((i, c / max(1, c.sum()) * idf[i]))
    scale = 1 / max(1e-9, float(np.mean([np.linalg.norm(x) for _, x in data])))
    data = [(np.append(i, D), np.append(x * scale, 1.0)) for i, x in data]
    y = np.array([langs.index(n) for n in names])
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    held &= np.bincount(y[~held], minlength=len(langs))[y] > 0  # no language is only held back
    w = ftrl([data[i] for i in np.flatnonzero(~held)], y[~held], len(langs), D + 1)
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    logits = np.stack([data[i][1] @ w[data[i][0]] for i in check])
    grid = np.geomspace(0.05, 20, 120)
    truth = np.eye(len(langs))[y[check]]
    truth = (truth * len(check) + 1 / len(langs)) / (len(check) + 1)  # one pseudo-count: without an error held back, the temperature stays finite
    loss = [-(truth * np.log(np.maximum(_softmax(logits / t), 1e-12))).sum(axis=1).mean() for t in grid]
    return Model(langs, w[:D] * (idf * scale)[:, None], w[D], float(grid[int(np.argmin(loss))]))


def predict(docs: DataFrame, model: Model | None, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its calibrated probability.

    `und` with score 0 for a null text, a text without a letter, or without a model. Columns of docs with the names in `into` are
    replaced, others stay; equal texts get equal predictions; of equally likely languages the first by name is given; a text of any length is read whole; an empty table stays empty.
    """
    docs = docs.drop(*into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model and (model.langs, model.weights.astype(np.float32), model.bias, model.temperature))  # D x languages, a fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, text, PIECE):
                pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if sent.value:
                    langs, w, bias, temperature = sent.value
                    grams, first, letters = _grams(data, at)
                    rows = np.flatnonzero(letters > 0)
                    if len(rows):
                        total = np.zeros((len(rows), len(langs)))
                        for c in range(len(langs)):
                            own = np.ascontiguousarray(w[:, c])
                            s = sum(own[g] for g in grams)  # rows without letters may lie between: reduce from start to start and end
                            total[:, c] = np.add.reduceat(np.append(s, 0.0), np.stack([first[rows], first[rows + 1]], 1).ravel(), dtype=np.float64)[::2]
                        z = total / (3 * np.diff(first)[rows])[:, None] + bias
                        p = _softmax(z / temperature)
                        score[rows] = p.max(axis=1)
                        for r, k in zip(rows.tolist(), p.argmax(axis=1).tolist(), strict=True):
                            pred[r] = langs[k]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred), pa.array(score)], names=[*part.schema.names, *into])

    return docs.mapInArrow(tidy(scan), schema)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the text without characters."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def accept(docs: DataFrame, model: Model | None, least: float = 0.4, text: str = "text") -> DataFrame:
    """docs whose language is one of the model's, with a score of `least` or more; without a model, docs with a letter. Columns as they were."""
    if model is None:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    found = predict(rows, model, into=("pred", "score"))
    return found.where((F.col("pred") != "und") & (F.col("score") >= least)).select("row.*")

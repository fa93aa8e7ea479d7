"""Repeated passages: which windows of `width` units (bytes or words) of any text also start anywhere else.

The search is exact and made in steps whose shuffles follow the repeated part of the corpus, not all of it:

1. anchors: each window chooses the smallest hash of its q-unit pieces. Equal windows choose the same piece, so
   a window can only repeat where its anchor's piece does. The windows of a text that share an anchor are neighbours; one row
   (anchor, hash of the stretch they cover, text, start, count) stands for them.
2. rows whose anchor occurs once are dropped. Equal stretches are one kind with a weight (1, or 2 for two places and more), by an aggregate
   with partial results, whatever the size of the group.
3. one stretch of each kind is cut out of its text and goes to a shard by its anchor; there a `solver` (suffix arrays or suffix trees)
   finds the windows that repeat, in other stretches or by the weight of their own.
   An anchor with more than `crowd` kinds, such as a line that very many texts hold between other words, is split:
   each of its windows goes by its own hash instead, and a count decides (the one case that no solver sees).
4. spans are gathered by text, merged, and cut out.

Texts are told apart by 64-bit hashes of theirs, so exact copies are one text with a count; a repeated text repeats
with all its windows. Groups of copies therefore never meet in one task. Nothing is collected to the driver and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import SPACE, U, Words, buffers, chunks, minimizers, mix, powers, powers_inverse, windows
from .shared import discard, materialize, tidy, trim

PIECE = 1 << 20  # units in work at once
#: A value for each byte, of 64 random-looking bits.
BYTES = mix(np.arange(1, 257).astype(U))


@dataclass(frozen=True)
class Unit:
    """How texts are cut up: by bytes, or by words between ASCII white space; the width of a window and of an anchor piece."""

    words: bool
    width: int
    piece: int

    @property
    def span(self) -> int:
        return self.width - self.piece + 1


def _units(unit: Unit, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words | None]:
    """A hash of each unit, the offsets of rows in units, the words."""
    if not unit.words:
        return data, at, None
    w = Words(data, at, SPACE)
    return w.hashes(), w.first, w


def _stretches(unit: Unit, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows grouped by their anchor: (row, start in units of the row, count of windows, anchor hash, stretch hash)."""
    n = len(h)
    step = PIECE
    lo = 0
    while lo + unit.width <= n:
        hi = min(n, lo + step + unit.width - 1)  # windows that start from lo to hi - width
        v = h[lo:hi] if unit.words else BYTES[h[lo:hi]]
        g = windows(v, unit.piece)
        best = minimizers(g, unit.span)
        row = np.searchsorted(first, np.arange(lo, lo + len(best)), "right") - 1 if len(first) > 2 else np.zeros(len(best), np.int64)
        ok = np.arange(lo, lo + len(best)) + unit.width <= first[row + 1]
        new = np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]) & ok
        s = np.flatnonzero(new)
        if len(s):
            stop = np.flatnonzero(np.concatenate([(best[1:] != best[:-1]) | (row[1:] != row[:-1]) | ~ok[1:], [True]]) & ok)
            p, e = best[s], stop + unit.width
            total = np.concatenate([np.zeros(1, U), np.cumsum(v * powers(len(v)), dtype=U)])
            inverse = powers_inverse(len(v))
            c = mix((total[e] - total[s]) * inverse[s] + mix((e - s).astype(U) * U(0x9FB21C651E98DF25) + (p - s).astype(U)))
            yield row[s], s + lo - first[row[s]], stop - s + 1, g[p], c
        lo += step


def _anchors(unit: Unit):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text", PIECE):
                h, first, _ = _units(unit, data, at)
                key = part.column(0).to_numpy()
                again = np.ones(len(key), bool)
                again[np.unique(key, return_index=True)[1]] = False  # copies in one chunk: once is enough
                for row, start, count, a, c in _stretches(unit, h, first):
                    m = ~again[row]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[m].view(np.int64), c[m].view(np.int64), key[row[m]], start[m].astype(np.int32), count[m].astype(np.int32))], names=["a", "c", "k", "s", "n"])

    return scan


def _cutter(unit: Unit):
    """Cut the stretches asked for out of their texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text", PIECE):
                _, first, w = _units(unit, data, at) if not unit.words else (None, (x := Words(data, at, SPACE)).first, x)
                out = []
                size = 0
                for row, asked in enumerate(part.column(1).to_pylist()):
                    for q in asked:
                        lo = first[row] + q["s"]
                        hi = lo + q["n"] - 1 + unit.width
                        text = data[w.starts[lo] : w.ends[hi - 1]] if unit.words else data[lo:hi]
                        out.append((q["a"], q["c"], q["n"], q["w"], text.tobytes()))
                        size += len(text)
                        if size > 8 << 20:
                            yield _asked(out)
                            out, size = [], 0
                if out:
                    yield _asked(out)

    return scan


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    a, c, n, w, x = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(w, pa.int32()), pa.array(x, pa.binary())], names=["a", "c", "n", "w", "x"])


#: From the units of several stretches (values, offsets, windows in each, weight of each) to whether the window that starts at a unit repeats.
Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _solved(unit: Unit, solver: Solver):
    def solve(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        a, c = group["a"].to_numpy(), group["c"].to_numpy()
        keep = np.sort(np.unique(np.stack([a, c]), axis=1, return_index=True)[1])  # a stretch may come from copies of its text
        group = group.take(pa.array(keep))
        data, at = buffers(group["x"].combine_chunks())
        count = group["n"].to_numpy()
        h, first, _ = _units(unit, data, at)
        hit = solver(h, first, count, group["w"].to_numpy())
        # maximal runs of repeated starts, as offsets in their stretch
        border = np.zeros(len(hit) + 1, bool)
        border[first] = True
        begin = np.flatnonzero(hit & (border[:-1] | ~np.concatenate([[False], hit[:-1]])))
        ends = np.flatnonzero(hit & (border[1:] | ~np.concatenate([hit[1:], [False]])))
        row = np.searchsorted(first, begin, "right") - 1
        trim()
        return pa.table({"a": group["a"].take(pa.array(row)), "c": group["c"].take(pa.array(row)), "lo": pa.array((begin - first[row]).astype(np.int32)), "hi": pa.array((ends - first[row] + unit.width).astype(np.int32))})

    return solve


def _exploded(unit: Unit):
    """Each window of a crowded anchor's stretches with its own hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "x", PIECE):
                h, first, _ = _units(unit, data, at)
                v = h if unit.words else BYTES[h]
                w = windows(v, unit.width)
                n = part.column(2).to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(off.astype(np.int32)), part.column(3).take(of), pa.array(w[first[row] + off].view(np.int64))], names=["a", "c", "lo", "many", "w"])

    return scan


def repeated_spans(docs: DataFrame, unit: Unit, solver: Solver, crowd: int = 20_000, shard_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): spans has k (text_key of a text), spans (array of lo, hi in units, unmerged); texts has k and copies.

    docs needs the columns k (text_key) and text. Only texts with copies or spans matter; a text with copies > 1 repeats with all its windows.
    """
    spark = docs.sparkSession
    # step 1, 2
    occ = materialize(docs.select("k", "text").where(F.octet_length("text") >= unit.width).mapInArrow(tidy(_anchors(unit)), "a long, c long, k long, s int, n int"), "anchors")
    place = F.xxhash64("k", "s")
    twice = occ.select("a", place.alias("x")).groupBy("a").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo != hi").select("a")
    twice = materialize(twice, "twice")  # read from files, a join with it can split a hot anchor
    alive = materialize(occ.join(twice, "a"), "alive")
    discard(occ, twice)
    kinds = materialize(alive.groupBy("a", "c").agg(F.min(F.struct("k", "s", "n")).alias("one"), F.when(F.min(place) != F.max(place), 2).otherwise(1).alias("w")), "kinds")
    # step 3
    crowded = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > crowd).select("a")
    asked = kinds.select("a", "c", "w", "one.*").select("k", F.struct("a", "c", "s", "n", "w").alias("q")).groupBy("k").agg(F.collect_list("q").alias("asked"))
    firsts = docs.groupBy("k").agg(F.min("doc_id").alias("d"))  # copies of a text would all be asked; one doc_id is
    asked = asked.join(firsts, "k").select("k", "asked", "d")
    texts = docs.join(asked.withColumnRenamed("k", "k2"), (F.col("k") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("text", "asked")
    cut = materialize(texts.mapInArrow(tidy(_cutter(unit)), "a long, c long, n int, w int, x binary"), "stretches")
    size = cut.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    shards = max(-(-size // shard_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (1 << 20))), 1)
    few = cut.join(crowded, "a", "left_anti").withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int"))
    found = few.groupBy("shard").applyInArrow(_solved(unit, solver), "a long, c long, lo int, hi int")
    wide = cut.join(crowded, "a", "left_semi").select("a", "c", "n", "w", "x").dropDuplicates(["a", "c"]).mapInArrow(tidy(_exploded(unit)), "a long, c long, lo int, many int, w long")
    equal = wide.groupBy("w").agg(F.min(F.xxhash64("a", "c", "lo")).alias("x"), F.max(F.xxhash64("a", "c", "lo")).alias("y"), F.max("many").alias("many")).where("x != y OR many > 1").select("w")
    found = found.unionByName(wide.join(equal, "w").select("a", "c", "lo", (F.col("lo") + unit.width).alias("hi")))
    found = materialize(found, "found")
    discard(cut, kinds)
    inner = alive.join(found, ["a", "c"]).select("k", (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi")).alias("hi"))
    spans = materialize(inner.distinct().groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(alive, found, free=True)
    return spans, docs.groupBy("k").agg(F.count(F.lit(1)).alias("copies"))


def with_key(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """k, doc_id and text of docs, a null text as an empty one, which is what repeated_spans() reads."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(t).alias("k"), F.col(doc_id).alias("doc_id"), t.alias("text"))


def covered(spans: list[dict] | None, copies: int, n: int, width: int) -> np.ndarray:
    """Merged maximal runs (lo, hi), from the spans of a text of n units."""
    if copies > 1 and n >= width:
        return np.array([[0, n]])
    if not spans:
        return np.zeros((0, 2), np.int64)
    x = np.array([(q["lo"], q["hi"]) for q in spans], np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    new = np.concatenate([[True], x[1:, 0] > reach[:-1]])
    return np.stack([x[new, 0], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])], 1)


def cut(docs: DataFrame, unit: Unit, solver: Solver, remove, text: str = "text", doc_id: str = "doc_id", into: str = "dedup", **how) -> DataFrame:
    """The columns of docs and a struct `into`: n_units, n_removed, n_spans, spans (int64 pairs of units), kept (binary).

    remove(unit, data, offsets, runs of each row) gives the kept bytes of each row of a chunk. Windows are judged on the input. A null or empty text has no
    units and keeps nothing; a text shorter than a window is kept whole; repeated rows are copies of one another; a column of
    docs named like `into` is replaced, others stay, whatever their names.
    """
    own = [c for c in docs.columns if c != into]
    rows = docs.select(F.struct(*own).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    spans, copies = repeated_spans(with_key(docs, text, doc_id), unit, solver, **how)
    verdict = copies.where("copies > 1").join(spans, "k", "full")
    schema = T.StructType([rows.schema["row"], T.StructField(into, T.StructType.fromDDL("n_units long, n_removed long, n_spans long, spans binary, kept binary"))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text", PIECE):
                first = at if not unit.words else (w := Words(data, at, SPACE)).first
                found, times = part.column(2).to_pylist(), part.column(3).to_pylist()
                runs = [covered(found[i], times[i] or 1, int(first[i + 1] - first[i]), unit.width) for i in range(part.num_rows)]
                kept = remove(data, at, None if not unit.words else w, runs)
                out = pa.StructArray.from_arrays(
                    [
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array([int((r[:, 1] - r[:, 0]).sum()) for r in runs], pa.int64()),
                        pa.array([len(r) for r in runs], pa.int64()),
                        pa.array([r.astype(np.int64).tobytes() for r in runs], pa.binary()),
                        pa.array(kept, pa.binary()),
                    ],
                    names=["n_units", "n_removed", "n_spans", "spans", "kept"],
                )
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=["row", into])

    joined = rows.join(verdict, "k", "left").select("row", "text", "spans", "copies")
    return joined.mapInArrow(tidy(scan), schema).select("row.*", into)

"""MinHash near-dedup with bottom-k sketches.

One hash function gives every shingle a value; a document's sketch is its k smallest. Documents with equal sets are one class (found by fingerprints,
whatever the size of the group), and classes are compared:

1. inverted lists of retained values. Two sketches that share enough for a link share one of their rarest values (prefix filter, below),
   so each class stands only in the lists of those; no pair is lost by it.
2. within a list, overlaps of all pairs come from a product of membership matrices. A pair that could pass gets its union sketch: of the k smallest
   values of the union, the share that both hold estimates the similarity. A pair at the threshold that shares fewer than required
   has a probability under LOSS, by the exact binomial tail (1.2e-9 at 0.85, 3.3e-9 at 0.80; sets of up to k shingles together: never).
   Lists that leave the same members are done once.
3. the full sets of what is left meet, and exact intersections, again as a product, verify the links. A task returns a spanning forest of its
   links and never all pairs.
4. connected components over the links of all lists.

Prefix filter: retained values are ordered by how many classes retain them, then by value. If `need` of a sketch's n values must be shared, then one of the
first n - need + 1 of each partner is. Values of one class alone come first, so most classes stand in no list at all.

A list of more than `crowd` classes is dealt out in blocks: every pair of blocks meets in one task, so no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .flat import LOWER, SPACE, U, Words, chunks, mix, windows
from .shared import discard, materialize, tidy, trim

CHUNK = 2 << 20
LOSS = 4e-9  # probability with which estimates may drop a pair at the threshold


def _sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, and their offsets; a row with fewer words has its whole sequence as one."""
    w = Words(LOWER[data], at, SPACE)
    h = w.hashes()
    g = windows(h, width)
    full = w.left()[: len(g)] >= width
    value, row = g[full], w.owner[: len(g)][full]
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        extra = np.array([int(mix(np.array([windows(h[w.first[r] : w.first[r + 1]], int(w.counts[r]))[0] ^ U(int(w.counts[r]))], U))[0]) for r in short], U)
        value, row = np.concatenate([value, extra]), np.concatenate([row, short])
    by = np.argsort(value)
    by = by[np.argsort(row[by], kind="stable")]
    value, row = value[by], row[by]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
        value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(at)))


def _sketches(width: int, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text", CHUNK):
                value, first = _sets(data, at, width)
                n = np.diff(first)
                mixed = np.concatenate([np.zeros(1, U), np.cumsum(mix(value ^ U(0x5851F42D4C957F2D)), dtype=U)])
                other = np.concatenate([np.zeros(1, U), np.cumsum(mix(value + U(0x14057B7EF767814F)), dtype=U)])
                f = mix((mixed[first[1:]] - mixed[first[:-1]]) ^ mix(other[first[1:]] - other[first[:-1]] + n.astype(U)))
                sketch = [value[a : a + min(k, c)].tobytes() for a, c in zip(first[:-1].tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n.astype(np.int64)), pa.array(f.view(np.int64)), pa.array(sketch, pa.binary())], names=["row", "k", "rid", "n_shingles", "class", "sketch"])

    return scan


def _retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, class, n) for each retained value of a class and the number of them."""
    for batch in batches:
        sketches = [np.frombuffer(s, U) for s in batch.column(1).to_pylist()]
        if sketches:
            n = np.array([len(v) for v in sketches], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sketches).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(n, n))], names=["key", "class", "n"])


def _rarest(classes: DataFrame, k: int, least: int) -> DataFrame:
    """(key, class): the retained values by which a class has to be found, those that others retain too."""
    kept = materialize(classes.select("class", "sketch").mapInArrow(tidy(_retained), "key long, class long, n int"), "retained")
    shared = materialize(kept.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    own = kept.join(shared, "key").groupBy("class").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("m", "key"))).alias("own"))  # k entries at most
    need = F.ceil(F.lit(least) * F.col("n") / k)  # a partner shares so many: its union with this set is no smaller than this set
    some = own.withColumn("keys", F.size("own") - need + 1).where("keys > 0")
    out = materialize(some.select("class", F.explode(F.slice("own", 1, F.col("keys").cast("int"))).alias("x")).select(F.col("x.key").alias("key"), "class"), "keys")
    discard(kept, shared)
    return out


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Values that only one set has are left out; the rest are multiplied in blocks of columns."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = seen[column] > 1
    row, column = row[keep], np.unique(column[keep], return_inverse=True)[1]
    out = np.zeros((m, m), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    width = max(64, (4 << 20) // max(m, 1))
    for lo in range(0, int(column.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        member = np.zeros((m, int(column[b - 1]) - lo + 1), np.float32)
        member[row[a:b], column[a:b] - lo] = 1
        out += member @ member.T
    return out


def _forest(linked: np.ndarray) -> np.ndarray:
    """The smallest member that each member of a symmetric relation can reach."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _least_shared(k: int, threshold: float) -> int:
    """How many of the k smallest values of a union both sets must hold; a pair at the threshold holds fewer with a probability under LOSS."""
    tail = 0.0
    for c in range(k):
        tail += comb(k, c) * threshold**c * (1 - threshold) ** (k - c)
        if tail >= LOSS:
            return c
    return k


def _union_sketch(a: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """How many of the k smallest values of the union of a and each row of others both hold. Rows ascend and are filled up with the largest value."""
    place = np.searchsorted(a, others)
    common = (a[np.minimum(place, len(a) - 1)] == others) & (place < len(a))
    rank = place + np.arange(others.shape[1]) - (np.cumsum(common, axis=1) - common)  # in the union, for a common value
    return (common & (rank < k)).sum(axis=1)


def _estimated_groups(sets: list[np.ndarray], k: int, least: int) -> np.ndarray:
    """A label for each sketch: those that estimates link, directly or by others, share one."""
    m, size = len(sets), np.array([len(s) for s in sets])
    both = _overlaps(sets)
    union = np.minimum(k, size[:, None] + size[None, :] - both)
    may = k * both >= least * union
    label = np.arange(m)
    np.fill_diagonal(may, False)
    if not may.any():
        return label
    flat = np.full((m, k), U(0xFFFFFFFFFFFFFFFF), U)
    for i, s in enumerate(sets):
        flat[i, : len(s)] = s
    free = np.ones(m, bool)
    for root in range(m):
        if not free[root]:
            continue
        free[root] = False
        open_ = [root]
        while open_:
            i = open_.pop()
            near = np.flatnonzero(may[i] & free)
            if len(near):
                near = near[k * _union_sketch(sets[i], flat[near], k) >= least * union[i, near]]
                label[near], free[near] = root, False
                open_ += near.tolist()
    return label


def _estimated(k: int, threshold: float):
    """From the members of lists (key, class, sketch) to groups (group, class) that may hold a link."""
    least = _least_shared(k, threshold)

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("class", "ascending")])
        keys, of = table["key"].to_numpy(), table["class"].to_numpy()
        sketches = table["sketch"].to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        groups, members, done = [], [], set()
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if (whole := of[lo:hi].tobytes()) in done:
                continue
            done.add(whole)
            label = _estimated_groups([np.frombuffer(x, U) for x in sketches[lo:hi]], k, least)
            for g in np.flatnonzero(np.bincount(label) > 1):
                own = of[lo:hi][label == g]
                groups.append(np.full(len(own), int(mix(np.frombuffer(own.tobytes(), U) * U(0xFF51AFD7ED558CCD) + np.arange(len(own)).astype(U)).sum(dtype=U)), U).view(np.int64))
                members.append(own)
        trim()
        if not groups:
            return pa.table({"g": pa.array([], pa.int64()), "class": pa.array([], pa.int64())})
        return pa.table({"g": np.concatenate(groups), "class": np.concatenate(members)})

    return solve


def _verified(percent: int):
    """From groups (g, class, set) to links along a spanning forest (u, v), by exact Jaccard on full sets."""

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("g", "ascending"), ("class", "ascending")])
        g, of, values = table["g"].to_numpy(), table["class"].to_numpy(), table["set"].to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        u, v = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            keep = np.flatnonzero(np.concatenate([[True], of[lo + 1 : hi] != of[lo : hi - 1]])) + lo  # a set may come twice, from equal rows
            sets = [np.frombuffer(values[i], U) for i in keep]
            size = np.array([len(s) for s in sets], np.int64)
            both = _overlaps(sets).astype(np.int64)
            label = _forest(100 * both >= percent * (size[:, None] + size[None, :] - both))
            there = np.flatnonzero(label != np.arange(len(label)))
            u.append(of[keep[there]])
            v.append(of[keep[label[there]]])
        trim()
        return pa.table({"u": pa.array(np.concatenate(u), pa.int64()), "v": pa.array(np.concatenate(v), pa.int64())})

    return solve


def _full(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text", CHUNK):
                value, first = _sets(data, at, width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([value[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["class", "set"])

    return scan


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, k: int = 32, crowd: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, k (64-bit key of the text), n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).

    Words are split at ASCII white space after lower-casing A-Z. Documents are linked if 100 * intersection >= percent * union of their shingle sets.
    A null text, or one without words, has no shingles and is linked with nothing; equal rows belong to one component and, sharing the smallest
    id, are all marked kept (drop_near_duplicates keeps one); a null doc_id counts only where its component has no other; a text of any length is read whole. Other columns are
    not read, whatever their names; an empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("long").alias("rid"))
    return _components_of(base, percent, width, k, crowd).select("doc_id", "k", "n_shingles", "component_id", "kept")


def _components_of(base: DataFrame, percent: int = 85, width: int = 5, k: int = 32, crowd: int = 4096) -> DataFrame:
    """near_duplicates of doc_id, text and rid (a row's number, or null), with rid and the component's root, a class (null without shingles)."""
    spark = base.sparkSession
    base = base.select("doc_id", F.xxhash64("text").alias("k"), "text", "rid")
    kind = base.schema["doc_id"].dataType.simpleString()
    rows = materialize(base.select(F.col("doc_id").alias("row"), "k", "rid", "text").mapInArrow(tidy(_sketches(width, k)), f"row {kind}, k long, rid long, n_shingles long, class long, sketch binary"), "sketches")
    some = rows.where("n_shingles > 0")
    classes = materialize(some.groupBy("class").agg(F.min("row").alias("low"), F.min(F.struct("k", "row", "sketch")).alias("one")).select("class", "low", "one.k", F.col("one.row").alias("row"), "one.sketch"), "classes")
    keys = _rarest(classes, k, _least_shared(k, percent / 100))
    sizes = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "lists")
    total = sizes.agg(F.sum("m")).first()[0] or 0
    # long lists go out in blocks, each pair of blocks under a key of its own
    blocks = F.ceil(F.col("m") * 2 / crowd).cast("int")
    member = keys.join(sizes, "key").withColumn("b", blocks)
    own = F.pmod(F.xxhash64(F.col("class")), F.col("b"))
    cells = F.when(F.col("b") < 3, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.xxhash64(F.least(j.cast("long"), own), F.greatest(j.cast("long"), own))))
    member = member.select("class", F.col("key").alias("k0"), F.explode(cells).alias("cell")).select("class", F.when(F.col("cell") == 0, F.col("k0")).otherwise(F.xxhash64("k0", "cell")).alias("key"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 20_000))
    listed = member.join(classes.select("class", "sketch"), "class").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    groups = materialize(listed.groupBy("bucket").applyInArrow(_estimated(k, percent / 100), "g long, class long").distinct(), "groups")
    wanted = groups.select("class").distinct().join(classes.select("class", F.col("k").alias("k2"), F.col("row").alias("r")), "class")
    sets = base.join(wanted, (F.col("k") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("r"))).select("class", "text").mapInArrow(tidy(_full(width)), "class long, set binary")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // 2_000))
    shipped = groups.join(sets, "class").withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int"))
    links = materialize(shipped.groupBy("bucket").applyInArrow(_verified(percent), "u long, v long"), "links")
    roots = components(links)
    low = classes.join(roots.withColumnRenamed("u", "class"), "class", "left").select("class", "low", F.coalesce("root", "class").alias("root"))
    low = low.join(low.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("class", "component_id", "root")
    out = rows.join(low, "class", "left").select(F.col("row").alias("doc_id"), "k", "rid", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("row")).alias("component_id"), "root")
    out = materialize(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near")
    discard(rows, classes, keys, sizes, groups, links, roots, free=True)
    return out


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """docs with one document of each group: that with the smallest id (a null one comes last), and one row of it where rows repeat.

    Groups are told apart by their texts, so that neither null ids nor an id that two texts share drop anything. Documents without words all stay, but
    rows that repeat an id and a text; columns as they were, whatever their names. Rows are numbered first, in a table of the shared folder, and chosen by that number.
    """
    own = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid")), "numbered")
    base = own.select(F.col("row")[doc_id].alias("doc_id"), F.coalesce(F.col("row")[text], F.lit("")).alias("text"), "rid")
    near = _components_of(base, **how)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k", "rid")).alias("one")
    full = near.where("n_shingles > 0").groupBy("root").agg(first).select("one.rid")
    empty = near.where("n_shingles = 0 AND doc_id IS NOT NULL").groupBy("doc_id", "k").agg(F.min("rid").alias("rid")).select("rid")
    unnamed = near.where("n_shingles = 0 AND doc_id IS NULL").select("rid")
    return own.join(full.unionByName(empty).unionByName(unnamed), "rid", "left_semi").select("row.*")

"""Benchmark decontamination with suffix arrays over the training texts.

Every chunk of documents is a shard with a suffix array of its words (Larsson-Sadakane prefix doubling over ranks, on word
hashes of 64 bits). Every suffix of every benchmark item that begins a window is binary-searched in every shard: the range of suffixes that
share its first words gives all places of that window. For each place the longest verbatim match is sought among the benchmark
suffixes that begin with the same window; documents go by the words that those matches cover. A document lies in one shard, whole, so one scan decides
it and no text is shuffled.

The benchmark is a stated query set. Its words are sent to the executors in blocks of at most `block_bytes` of text; the size is measured first, so nothing
unbounded is broadcast or collected. A benchmark of several blocks takes one scan of the documents for each: a block is read, sent, searched for, and freed before
the next, and only what it hits is written.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import LOWER, PUNCT, Sequence, Words, buffers, chunks
from .shared import discard, materialize, tidy

BLOCK_BYTES = 32 << 20
SHARD = 2 << 20  # bytes of text in one suffix array, about
RESULT = "n_words long, n_hit long, n_items long, items array<string>, hits binary, longest long, longest_word long"


def suffix_array(words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the word sequences in lexicographic order of word hashes, settled to at least depth words.

    left: the words from each position to the end of its document; an ended suffix sorts first.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.concatenate([[True], words[order][1:] != words[order][:-1]]) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start + 1
    have = 1
    while have < depth:
        single = new & np.concatenate([new[1:], [True]])
        at = np.flatnonzero(~single)  # places in the array where suffixes still tie
        if not len(at):
            break
        tied = order[at]
        after = np.where(left[tied] > have, rank[np.minimum(tied + have, n - 1)], 0)
        key = rank[tied] * (n + 2) + after
        by = np.argsort(key, kind="stable")
        order[at], key = tied[by], key[by]
        new[at[1:]] = (key[1:] != key[:-1]) | (np.diff(at) > 1)
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[at]] = start[at] + 1
        have *= 2
    return order


@dataclass
class Block:
    """Suffixes of some benchmark items. A window is `window` words; an item with fewer is one window."""

    text: Sequence
    starts: np.ndarray  # one start of each distinct window
    widths: np.ndarray
    items: list[list[str]]  # names of the items that hold each distinct window
    sorted: np.ndarray  # all starts of windows, in the order of windows and then of their suffixes
    first: np.ndarray  # where each window's starts begin in there


def _parts(bench: DataFrame, text: str, item_id: str, block_bytes: int) -> Iterator[pa.Table]:
    """The benchmark (item, text) in tables of block_bytes of text, about, one at a time."""
    bench = bench.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for b in range(n):
        yield (bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else bench).toArrow().combine_chunks()


def _words_of(table: pa.Table) -> tuple[Words, Sequence]:
    data, at = buffers(table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string()))
    w = Words(LOWER[data], at, PUNCT)
    return w, Sequence(w.hashes(), w.left())


def _block(table: pa.Table, window: int) -> Block:
    w, seq = _words_of(table)
    names = table["item"].to_pylist()
    length = w.counts[w.owner] if len(w) else np.zeros(0, np.int64)
    begins = np.arange(len(w)) == w.first[w.owner] if len(w) else np.zeros(0, bool)
    starts = np.flatnonzero((seq.left >= window) | (begins & (length < window)))
    widths = np.minimum(length[starts], window)
    distinct: dict[bytes, int] = {}
    which = np.zeros(len(starts), np.int64)
    at, wide, items = [], [], []
    for j, (s, k) in enumerate(zip(starts.tolist(), widths.tolist(), strict=True)):
        which[j] = i = distinct.setdefault(seq.words[s : s + k].tobytes(), len(at))
        if i == len(at):
            at.append(s), wide.append(k), items.append(set())
        if names[w.owner[s]] is not None:
            items[i].add(names[w.owner[s]])
    place = np.empty(len(w), np.int64)
    place[suffix_array(seq.words, seq.left, int(w.counts.max(initial=0)))] = np.arange(len(w))
    by = np.lexsort((place[starts], which))
    first = np.searchsorted(which[by], np.arange(len(at) + 1))
    return Block(seq, np.array(at, np.int64), np.array(wide, np.int64), [sorted(x) for x in items], starts[by], first)


def _bound(order: np.ndarray, shard: Sequence, block: Sequence, starts: np.ndarray, widths: np.ndarray, upper: bool) -> np.ndarray:
    """For each stretch of the block, how many suffixes of the shard sort before it (upper: or begin with it)."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        at, q, k = order[mid], starts[open_], widths[open_]
        less = np.full(len(open_), upper)  # of the suffix against the stretch; equal so far counts as upper says
        live = np.arange(len(open_))
        for d in range(int(k.max(initial=0))):
            live = live[k[live] > d]
            ended = shard.left[at[live]] <= d
            less[live[ended]] = True
            live = live[~ended]
            a, b = shard.words[at[live] + d], block.words[q[live] + d]
            less[live[a != b]] = (a < b)[a != b]
            live = live[a == b]
            if not len(live):
                break
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    return lo


def _search(shard: Sequence, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (word positions), the window found at each, and the words of the longest verbatim match there."""
    none = np.zeros(0, np.int64)
    if not len(shard.words) or not len(block.starts):
        return none, none, none
    order = suffix_array(shard.words, shard.left, int(block.widths.max()))
    lo, hi = (_bound(order, shard, block.text, block.starts, block.widths, up) for up in (False, True))
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    place = order[lo[which] + inside]
    return place, which, _longest(shard, place, block, which)


def _longest(shard: Sequence, place: np.ndarray, block: Block, which: np.ndarray) -> np.ndarray:
    """The longest match of each place with a benchmark suffix of its window: those next to it in their order share most."""
    lo, hi = block.first[which], block.first[which + 1]
    begin, end = lo, hi
    best = block.widths[which].copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        at, there = place[open_], block.sorted[mid]
        n = shard.common(at, block.text, there)
        a = np.where(shard.left[at] > n, shard.words[np.minimum(at + n, len(shard.words) - 1)], 0)
        b = np.where(block.text.left[there] > n, block.text.words[np.minimum(there + n, len(block.text.words) - 1)], 0)
        ended = block.text.left[there] <= n  # the benchmark's suffix is a prefix of the place's: it sorts before, or is equal
        below = ended | ((shard.left[at] > n) & (b < a))
        lo, hi = lo.copy(), hi.copy()
        lo[open_] = np.where(below, mid + 1, lo[open_])
        hi[open_] = np.where(below, hi[open_], mid)
    for side in (lo - 1, lo):
        ok = np.flatnonzero((side >= begin) & (side < end))
        best[ok] = np.maximum(best[ok], shard.common(place[ok], block.text, block.sorted[side[ok]]))
    return best


@dataclass
class Found:
    """What a chunk's rows hold of a block: hit words (a mask), names of items, the longest match and its first word."""

    words: Words
    hit: np.ndarray
    items: list[set]
    longest: np.ndarray
    at: np.ndarray


def _found(data: np.ndarray, at: np.ndarray, block: Block | None) -> Found:
    w = Words(LOWER[data], at, PUNCT)
    rows = len(at) - 1
    items: list[set] = [set() for _ in range(rows)]
    longest, first = np.zeros(rows, np.int64), np.full(rows, -1)
    if block is None or not len(w):
        return Found(w, np.zeros(len(w), bool), items, longest, first)
    place, which, size = _search(Sequence(w.hashes(), w.left()), block)
    step = np.zeros(len(w) + 1, np.int32)
    np.add.at(step, place, 1)
    np.add.at(step, place + size, -1)
    own = w.owner[place]
    for row, k in np.unique(np.stack([own, which]), axis=1).T.tolist():
        items[row].update(block.items[k])
    by = np.lexsort((place, -size, own))
    lead = by[np.concatenate([[True], own[by][1:] != own[by][:-1]])] if len(by) else by
    longest[own[lead]], first[own[lead]] = size[lead], place[lead] - w.first[own[lead]]
    return Found(w, np.cumsum(step[:-1]) > 0, items, longest, first)


def _spans(found: Found, row: int) -> bytes:
    own = found.hit[found.words.first[row] : found.words.first[row + 1]]
    if not own.any():
        return b""
    return np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).astype(np.int64).tobytes()


KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("hits", pa.binary()), ("longest", pa.int64()), ("longest_word", pa.int64())])


def _result(found: Found, row: int) -> dict:
    spans = _spans(found, row)
    n_hit = int(np.diff(np.frombuffer(spans, np.int64).reshape(-1, 2)).sum())
    items = sorted(found.items[row])
    return {"n_words": int(found.words.counts[row]), "n_hit": n_hit, "n_items": len(items), "items": items, "hits": spans, "longest": int(found.longest[row]), "longest_word": int(found.at[row]) if found.at[row] >= 0 else None}


def contamination(docs: DataFrame, bench: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", bench_text: str = "text", into: str = "contamination", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs and a struct `into`: n_words, n_hit, n_items, items (names, sorted), hits (int64 word spans), longest (words of the longest
    verbatim match with one item, if it is a window or more, else 0), longest_word (where the first such match begins, from 0, else null).

    Words are runs of letters a-z (after lower-casing A-Z), digits and characters outside ASCII. A null or empty text has no words and no
    hits; items without words have no windows; an item without a name hits words but is not listed; rows that repeat are
    decided each on its own; an empty benchmark hits nothing; a text of any length is one shard, whole; a column of docs that is already called `into` is
    replaced, others stay, whatever their names; an empty table stays empty.
    """
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StructType.fromDDL(RESULT))])
    context = docs.sparkSession.sparkContext
    parts = _parts(bench, bench_text, item_id, block_bytes)
    block, table = _block(next(parts), window), next(parts, None)
    if table is None:
        return docs.mapInArrow(tidy(_scanner(context.broadcast(block), text, into)), schema)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    tables = []
    while block is not None:
        sent = context.broadcast(block)
        tables.append(materialize(keyed.select("k", "text").mapInArrow(tidy(_hitter(sent)), "k long, spans binary, items array<string>, longest long, longest_word long"), "hits"))
        sent.destroy()
        block, table = (None if table is None else _block(table, window)), next(parts, None)
    hits = tables[0]
    for t in tables[1:]:
        hits = hits.unionByName(t)
    hits = materialize(hits.dropDuplicates().groupBy("k").agg(F.collect_list(F.struct("spans", "items", "longest", "longest_word")).alias("found")), "found")  # one entry a block
    discard(*tables)
    schema = T.StructType([keyed.schema["row"], T.StructField(into, T.StructType.fromDDL(RESULT))])
    return keyed.join(hits, "k", "left").select("row", "text", "found").mapInArrow(tidy(_merger(into)), schema).select("row.*", into)


def _scanner(sent, text: str, into: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, text, SHARD):
                found = _found(data, at, sent.value)
                rows = [_result(found, row) for row in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, KIND)], names=[*part.schema.names, into])

    return scan


def _hitter(sent):
    """k and what a block hits, for the rows that it hits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text", SHARD):
                found = _found(data, at, sent.value)
                rows = np.flatnonzero(found.longest > 0)
                columns = [part.column(0).take(pa.array(rows)), pa.array([_spans(found, r) for r in rows], pa.binary()), pa.array([sorted(found.items[r]) for r in rows], pa.list_(pa.string())), pa.array(found.longest[rows]), pa.array(found.at[rows])]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "spans", "items", "longest", "longest_word"])

    return scan


def _merger(into: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in chunks(batch, "text", SHARD):
                found = _found(data, at, None)
                for row, blocks in enumerate(part.column(2).to_pylist()):
                    for x in blocks or ():
                        for a, b in np.frombuffer(x["spans"], np.int64).reshape(-1, 2) + found.words.first[row]:
                            found.hit[a:b] = True
                        found.items[row].update(x["items"])
                        if (x["longest"], -x["longest_word"]) > (found.longest[row], -found.at[row]):
                            found.longest[row], found.at[row] = x["longest"], x["longest_word"]
                rows = [_result(found, row) for row in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, KIND)], names=["row", into])

    return scan


def decontaminate(docs: DataFrame, bench: DataFrame, max_share: float = 0.0, text: str = "text", **how) -> DataFrame:
    """docs without the documents of whose words verbatim matches of a window or more cover more than max_share; columns as they were, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    found = contamination(rows, bench, text="text", into="found", **how)
    return found.where(F.col("found.n_hit") <= max_share * F.col("found.n_words")).select("row.*")


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def longest_matches(docs: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", bench_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each benchmark suffix the longest verbatim match over all shards: item_id (string), item_word, length, doc_id, doc_word.

    Suffixes that match nowhere are left out; of equally long matches the smallest (doc_id, doc_word) among the shards' own is given (a null id first). Ids may be of any
    type. A task gives at most one row for each suffix.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    tables = []
    for table in _parts(bench, bench_text, item_id, block_bytes):
        words, seq = _words_of(table)
        named = [n for n, k in zip(table["item"].to_pylist(), words.counts.tolist(), strict=True) for _ in range(k)]
        sent = docs.sparkSession.sparkContext.broadcast((seq, named, np.arange(len(words)) - (words.first[words.owner] if len(words) else 0), int(words.counts.max(initial=0))))
        tables.append(materialize(docs.mapInArrow(tidy(_matcher(sent)), f"item_id string, item_word long, length long, doc_id {kind}, doc_word long"), "matches"))
        sent.destroy()
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    best = out.where("item_id IS NOT NULL").groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("length")).alias("n"), "doc_id", "doc_word")).alias("b"))
    return best.select("item_id", "item_word", (-F.col("b.n")).alias("length"), "b.doc_id", "b.doc_word")


def _matcher(sent):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, named, inside, longest = sent.value
        every = np.arange(len(block.words))
        best, place, ids = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), np.full(len(every), None, object)
        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for part, data, at in chunks(batch, "text", SHARD):
                w = Words(LOWER[data], at, PUNCT)
                if not len(w) or not len(every):
                    continue
                shard = Sequence(w.hashes(), w.left())
                order = suffix_array(shard.words, shard.left, longest)
                lo = _bound(order, shard, block, every, block.left, False)
                for side in (lo, lo - 1):
                    ok = np.flatnonzero((side >= 0) & (side < len(order)))
                    n = block.common(every[ok], shard, order[side[ok]])
                    more = n > best[ok]
                    at_ = order[side[ok[more]]]
                    best[ok[more]], place[ok[more]] = n[more], at_ - w.first[w.owner[at_]]
                    ids[ok[more]] = np.array([*part.column(0).take(pa.array(w.owner[at_])).to_pylist(), None], object)[:-1]
        some = np.flatnonzero(best)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([named[i] for i in some], pa.string()), pa.array(inside[some]), pa.array(best[some]), pa.array(ids[some].tolist(), kind), pa.array(place[some])], names=["item_id", "item_word", "length", "doc_id", "doc_word"])

    return scan

"""Whole Arrow string columns as flat NumPy buffers: words, hashes and windows of many texts at once.

A batch is cut into chunks of bounded bytes (a single longer text makes its own chunk), so that memory
follows the chunk and not the Arrow batch. All positions are exact byte or word offsets; no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 4 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd

#: Bytes that separate words: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside words of letters and digits: [\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_POWERS = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64; grown when needed."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1 << 12), BASE, U)  # mixing in a Python integer would go through floats
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=U)
    return _POWERS[:n]


_INVERSE = np.ones(1, U)


def powers_inverse(n: int) -> np.ndarray:
    """BASE**0 .. BASE**-(n-1) modulo 2**64."""
    global _INVERSE
    if len(_INVERSE) < n:
        steps = np.full(n, pow(BASE, -1, 1 << 64), U)
        steps[0] = 1
        _INVERSE = np.cumprod(steps, dtype=U)
    return _INVERSE[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the offsets (n + 1) of a string or binary array; a null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch of at most limit bytes of text (or one row), each with its bytes and offsets."""
    i = batch.schema.get_field_index(column)
    _, at = buffers(batch.column(i))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        part = batch.slice(lo, hi - lo)
        yield part, *buffers(part.column(i))
        lo = hi


class Words:
    """The words of a chunk: starts and ends (bytes), owner (row of each word), first (word offset of each row, n + 1)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, separators: np.ndarray):
        inside = np.zeros(len(data) + 1, np.int8)
        inside[:-1] = ~separators[data]
        step = np.diff(inside, prepend=np.int8(0))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cuts = at[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts - 1] == 1)]  # a word that would run over the border of two rows
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, at)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(at) - 1), self.counts)
        self.data = data

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; a few hundred thousand words at a time, to bound memory."""
        out = np.empty(len(self), U)
        for lo in range(0, len(self), 1 << 18):
            starts = self.starts[lo : lo + (1 << 18)]
            size = self.ends[lo : lo + (1 << 18)] - starts
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begin, size)
            take = self.data[within + np.repeat(starts, size)].astype(U) + U(1)
            take *= powers(int(size.max()))[within]
            out[lo : lo + (1 << 18)] = mix(np.add.reduceat(take, begin) + size.astype(U))
        return out

    def left(self) -> np.ndarray:
        """For each word, the number of words from it to the end of its row, itself included."""
        return self.first[1:][self.owner] - np.arange(len(self))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width values; len(h) - width + 1 of them (rows are not regarded)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out, have, done = np.zeros(n, U), h * U(0xD6E8FEB86659FD93) + U(1), 0
    span, size = have, 1  # hash of runs of a power of two
    p = 0xA0761D6478BD642F
    while True:
        if width & size:
            out = out * U(pow(p, size, 1 << 64)) + span[done : done + n]
            done += size
        if size * 2 > width:
            return mix(out)
        span = span[:-size] * U(pow(p, size, 1 << 64)) + span[size:]
        size *= 2


def minimizers(g: np.ndarray, span: int) -> np.ndarray:
    """For each run of span values, the position of its smallest, the leftmost of equals: len(g) - span + 1 of them.

    Whatever holds the same run of values chooses the same place in it.
    """
    n = len(g)
    if n < span:
        return np.zeros(0, np.int64)
    bits = max(20, int(n + span).bit_length())
    key = (g >> U(bits)) << U(bits)
    pad = (-n) % span
    key = np.concatenate([key, np.full(pad, U(0xFFFFFFFFFFFFFFFF), U)]) if pad else key
    key |= np.arange(n + pad).astype(U)
    blocks = key.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)  # from i to its block's end
    back = np.minimum.accumulate(blocks, axis=1).reshape(-1)  # from its block's start to i
    best = np.minimum(ahead[: n - span + 1], back[span - 1 : n])
    best &= U((1 << bits) - 1)
    return best.astype(np.int64)


class Sequence:
    """Hashed words with prefix sums, so that any two stretches can be compared at once; left: words from each place to the end of its row."""

    def __init__(self, words: np.ndarray, left: np.ndarray):
        self.words, self.left = words, left
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(words * powers(len(words)), dtype=U)])
        self.inverse = powers_inverse(len(words))

    def common(self, at: np.ndarray, other: Sequence, there: np.ndarray) -> np.ndarray:
        """How many words the suffixes at `at` share with the other's at `there`, for each pair: by halving, on hashes."""
        out = np.zeros(len(at), np.int64)
        open_ = np.flatnonzero(self.words[at] == other.words[there])
        a, b = at[open_], there[open_]
        lo, hi = np.ones(len(a), np.int64), np.minimum(self.left[a], other.left[b])
        mid, fixed = hi, (a, b, self.sums[a], other.sums[b], self.inverse[a], other.inverse[b])
        while len(open_):  # the whole length is tried first: what repeats mostly repeats for long
            a, b, x, y, u, v = fixed
            same = (self.sums[a + mid] - x) * u == (other.sums[b + mid] - y) * v
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            done = lo >= hi
            out[open_[done]] = lo[done]
            live = ~done
            open_, lo, hi = open_[live], lo[live], hi[live]
            fixed = tuple(f[live] for f in fixed)
            mid = (lo + hi + 1) // 2
        return out

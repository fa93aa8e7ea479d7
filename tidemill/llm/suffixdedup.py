"""Suffix-array dedup of exact byte strings.

Which 200-byte (by default) strings also start anywhere else is found by passages.repeated_spans(); the stretches of text that may repeat are
sorted in shards by external induced sorting (induced.descending: disk-backed queues of suffixes and common prefixes, in bounded memory).
A run of the suffix array in which neighbours share `width` bytes or more holds the places of one repeated string; the array comes in blocks and is never whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .induced import descending
from .passages import Unit, cut

LIMIT = 4 << 20  # bytes of each queue in memory
SHARD = 8 << 20  # bytes of a shard, about: larger than the queues hold


def repeated_starts(width: int, limit: int = LIMIT):
    """A solver over bytes: whether the `width` bytes at a place also start at another one. weight: in how many places a stretch is, if more than one counts as 2."""

    def solve(data: np.ndarray, first: np.ndarray, count: np.ndarray, weight: np.ndarray) -> np.ndarray:
        n, rows = len(data), len(count)
        hit = np.zeros(n, bool)
        if not n:
            return hit
        begin = first[:-1] + np.arange(rows)  # a stretch's first byte in the text, where a 1 ends each stretch
        text = np.ones(n + rows, np.uint16)
        for lo in range(0, rows, 1 << 14):
            some = np.arange(lo, min(rows, lo + (1 << 14)))
            a, b = int(first[some[0]]), int(first[some[-1] + 1])
            at = np.repeat(begin[some] - first[some], np.diff(first)[some]) + np.arange(a, b)
            text[at] = data[a:b].astype(np.uint16) + 2
        open_, total = [], 0  # places of the run that is not over yet, and their weight

        def over() -> None:
            if total > 1:
                for places in open_:
                    hit[places] = True

        for pos, lcp in descending(text, limit):
            row = np.searchsorted(begin, pos, "right") - 1
            off = pos - begin[row]
            start = off < count[row]
            cuts = np.flatnonzero(lcp < width)
            place, own, share = first[row[start]] + off[start], np.cumsum(lcp < width)[start], weight[row[start]]
            sums = np.bincount(own, share, minlength=len(cuts) + 1)
            total += sums[0]
            open_.append(place[own == 0])
            if len(cuts):
                over()
                hit[place[(sums > 1)[own] & (own > 0) & (own < len(cuts))]] = True
                open_, total = [place[own == len(cuts)]], sums[-1]
        over()
        return hit

    return solve


def _kept(data: np.ndarray, at: np.ndarray, words, runs: list[np.ndarray]) -> list[bytes]:
    out = []
    for i, r in enumerate(runs):
        own = data[at[i] : at[i + 1]]
        if len(r):
            stay = np.ones(len(own), bool)
            for lo, hi in r.tolist():
                stay[lo:hi] = False
            own = own[stay]
        out.append(own.tobytes())
    return out


def dedup_bytes(docs: DataFrame, width: int = 200, piece: int = 32, into: str = "dedup", limit: int = LIMIT, shard_bytes: int = SHARD, **how) -> DataFrame:
    """docs and the struct `into` (see passages.cut): every byte covered by a `width`-byte string that also starts anywhere else goes.

    width is from 2 * piece to 250 bytes (common prefixes are carried in a byte). Nulls, empty and long texts, repeated rows, empty tables and clashing names as in
    passages.cut.
    """
    if not 2 * piece <= width <= 250:
        raise ValueError("width must be from 2 * piece to 250")
    return cut(docs, Unit(False, width, piece), repeated_starts(width, limit), _kept, into=into, shard_bytes=shard_bytes, **how)

"""Substring dedup over words by prefix-partitioned suffix trees.

Which windows of 35 words (by default) also start anywhere else is found by passages.repeated_spans(); the stretches of text that may repeat go to
shards. There the suffixes are partitioned by prefixes of variable length until each group fits a bound, and the subtree of one group is built at a time: first
the order of its leaves and the depths at which neighbours branch (all leaves that are not told apart yet read the next words, more at a time as fewer stay open),
then its internal nodes, in one pass over those depths. Internal nodes at depth `width` or more are repeats; those whose leaves have different words before them are
maximal, and their leaves' stretches are what goes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .flat import U
from .passages import Unit, cut

GROUP = 1 << 18  # suffixes of one subtree, or of several small ones
CELLS = 1 << 21  # words read at once


def _branch(words: np.ndarray, pos: np.ndarray, node: np.ndarray, depth: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """Branch the nodes by the next `more` words of their suffixes; leaves that are alone go. node: ascending labels."""
    order = np.arange(len(pos))
    for k in reversed(range(more)):
        order = order[np.argsort(words[pos[order] + depth + k], kind="stable")]
    order = order[np.argsort(node[order], kind="stable")]
    pos, node = pos[order], node[order]
    new = np.concatenate([[True], node[1:] != node[:-1]])
    for k in range(more):
        w = words[pos + depth + k]
        new[1:] |= w[1:] != w[:-1]
    alone = new & np.concatenate([new[1:], [True]])
    label = np.cumsum(new)
    return pos[~alone], label[~alone]


def _partition(words: np.ndarray, pos: np.ndarray, width: int):
    """Groups of suffixes by prefixes of variable length: (suffixes, node labels, prefix length), each at most GROUP suffixes or settled."""
    open_ = [(pos, np.zeros(len(pos), np.int64), 0)]
    while open_:
        pos, node, depth = open_.pop()
        if len(pos) <= GROUP or depth >= width:
            yield pos, node, depth
            continue
        pos, node = _branch(words, pos, node, depth, 1)
        cut_at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(pos) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(cut_at, len(pos)))
        pack, held = [], 0
        for a, n in zip(cut_at.tolist(), sizes.tolist(), strict=True):
            if n > GROUP:
                open_.append((pos[a : a + n], node[a : a + n], depth + 1))
                continue
            if held + n > GROUP:
                yield np.concatenate([pos[x : x + m] for x, m in pack]), np.concatenate([node[x : x + m] for x, m in pack]), depth + 1
                pack, held = [], 0
            pack.append((a, n))
            held += n
        if pack:
            yield np.concatenate([pos[x : x + m] for x, m in pack]), np.concatenate([node[x : x + m] for x, m in pack]), depth + 1


def leaves(words: np.ndarray, pos: np.ndarray, stop: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (from pos to stop) in the order of a tree, and at which depth each branches off from the one before (0 between nodes).

    node: ascending labels of the prefixes of `depth` words that the suffixes have. A suffix that ends is told apart from all others there.
    """
    by = np.argsort(node, kind="stable")
    pos, stop, label = pos[by], stop[by], np.cumsum(np.concatenate([[True], node[by][1:] != node[by][:-1]]))
    branch = np.zeros(len(pos), np.int64)
    open_ = np.arange(len(pos))
    while len(open_):
        more = int(max(1, min(CELLS // len(open_), 8)))
        at, left = pos[open_] + depth, stop[open_] - pos[open_] - depth
        read = [np.where(left > k, words[np.minimum(at + k, len(words) - 1)], U(0)) for k in range(more)]
        by = np.lexsort((*read[::-1], label[open_]))
        pos[open_], stop[open_], own = pos[open_][by], stop[open_][by], label[open_][by]
        tied = own[1:] == own[:-1]
        same, shared = tied.copy(), np.zeros(len(tied), np.int64)
        for column in read:
            column = column[by]
            same &= (column[1:] == column[:-1]) & (column[1:] != 0)
            shared += same
        apart = tied & ~same
        branch[open_[1:][apart]] = depth + shared[apart]
        label[open_] = np.cumsum(np.concatenate([[True], ~same]))
        open_ = open_[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        depth += more
    return pos, branch


@dataclass
class Nodes:
    """Internal nodes of a subtree: depth and leaves from lo to hi (in the order of leaves); of[i] is the node in which leaf i meets the one before, or -1."""

    depth: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    of: np.ndarray


def internal_nodes(branch: np.ndarray, least: int) -> Nodes:
    """The internal nodes at depth `least` or more, from the depths at which neighbouring leaves branch: one pass with a stack, over deep leaves only."""
    deep = branch >= least
    edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    values, of = branch.tolist(), np.full(len(branch), -1)
    depth, lo, hi = [], [], []
    for a, b in edge.reshape(-1, 2).tolist():
        stack: list[int] = []
        for j in range(a, b):
            d, begin = values[j], j - 1
            while stack and depth[stack[-1]] > d:
                begin = lo[stack[-1]]
                hi[stack.pop()] = j
            if not stack or depth[stack[-1]] < d:
                stack.append(len(depth))
                depth.append(d), lo.append(begin), hi.append(0)
            of[j] = stack[-1]
        for t in stack:
            hi[t] = b
    return Nodes(np.array(depth, np.int64), np.array(lo, np.int64), np.array(hi, np.int64), of)


def repeats(words: np.ndarray, pos: np.ndarray, before: np.ndarray, branch: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the places of maximal repeats of `least` words or more: for each leaf its deepest node, if leaves of that have different words before them.

    before: whether the word before a leaf is known (it is in the same stretch). What a node's leaves all have before them is part of a longer repeat, with a node of its own.
    """
    nodes = internal_nodes(branch, least)
    if not len(nodes.depth):
        return pos[:0], pos[:0]
    ahead = np.where(before, words[np.maximum(pos - 1, 0)], U(0))
    change = np.concatenate([[0], np.cumsum((ahead[1:] != ahead[:-1]) | ~before[1:] | ~before[:-1])])
    maximal = change[nodes.hi - 1] > change[nodes.lo]
    after = np.append(nodes.of[1:], -1)
    here = np.where(nodes.of >= 0, nodes.depth[nodes.of], 0)
    there = np.where(after >= 0, nodes.depth[after], 0)
    own = np.where(here >= there, nodes.of, after)
    leaf = np.flatnonzero((own >= 0) & maximal[own])
    return pos[leaf], nodes.depth[own[leaf]]


def repeated_starts(width: int):
    """A solver over word hashes: whether the `width` words at a place also start at another one. weight: in how many places a stretch is, if more than one counts as 2."""

    def solve(words: np.ndarray, first: np.ndarray, count: np.ndarray, weight: np.ndarray) -> np.ndarray:
        step = np.zeros(len(words) + 1, np.int64)
        row = np.repeat(np.arange(len(count)), count)
        off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        starts = first[row] + off
        words = words.astype(U)
        for pos, node, depth in _partition(words, starts, width):
            own = np.searchsorted(first, pos, "right") - 1
            pos, branch = leaves(words, pos, first[own + 1], node, depth)
            before = pos > first[np.searchsorted(first, pos, "right") - 1]
            at, n = repeats(words, pos, before, branch, width)
            np.add.at(step, at, 1)
            np.add.at(step, at + n - width + 1, -1)
        many = np.flatnonzero(weight > 1)  # leaves that stand for several equal suffixes: their node is as deep as they are long
        np.add.at(step, first[many], 1)
        np.add.at(step, first[many] + count[many], -1)
        return np.cumsum(step[:-1]) > 0

    return solve


def _kept(data: np.ndarray, at: np.ndarray, words, runs: list[np.ndarray]) -> list[bytes]:
    out = []
    for i, r in enumerate(runs):
        lo, hi = words.first[i], words.first[i + 1]
        stay = np.ones(hi - lo, bool)
        for a, b in r.tolist():
            stay[a:b] = False
        out.append(b" ".join(data[words.starts[j] : words.ends[j]].tobytes() for j in (np.flatnonzero(stay) + lo).tolist()))
    return out


def dedup_words(docs: DataFrame, width: int = 35, piece: int = 8, into: str = "dedup", **how) -> DataFrame:
    """docs and the struct `into` (see passages.cut): every word covered by a window of `width` words that also starts anywhere else goes; kept words are joined by one space.

    Nulls, empty and long texts, repeated rows, empty tables and clashing names as in passages.cut.
    """
    return cut(docs, Unit(True, width, piece), repeated_starts(width), _kept, into=into, **how)

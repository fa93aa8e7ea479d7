"""Suffix and common-prefix arrays by external induced sorting, with disk-backed queues and recursion at every level.

A suffix is small (S) if it sorts before its successor, else large (L); S* suffixes are small ones after a large one. The order of the S* suffixes induces that of all
others, in two sweeps over the first characters: upwards for L suffixes, downwards for S suffixes. A sweep takes tuples (suffix, common
prefix with the tuple before) out of a queue ordered by first character, in blocks, and every tuple puts the suffix to its left back in. Common prefixes ride along: an
induced one is 1 + the minimum over the tuples between its inducers, of which a sweep keeps one running minimum for each character.

The order of the S* suffixes comes from the strings that begin with them and end behind the run at the next one (no such string is the beginning of another). They are
dealt out by first character and sorted there; equal strings get one name, and the shorter string of names is sorted in turn, by the same means. A name becomes one or more digits of
a small alphabet, so that there are never many queues; a string of names that is short enough is sorted at once. What the recursion says of common prefixes in names, the strings' own common prefixes complete to ones in characters.

Memory: the queue, what a sweep leaves for the next and the seeds each hold at most `limit` bytes and keep the rest in temporary files; the text, the S* positions and
the names are arrays, mapped from temporary files when they are larger than that. The result is not kept: it is handed on in blocks, in descending order.
Temporary files belong to their task and go with it, like Spark's own spills: a task that is run again elsewhere needs none of them.
"""

from __future__ import annotations

import math
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

from .flat import Sequence, mix

CAP = 250  # common prefixes are carried in a byte, up to this
SAME = 255  # two equal strings
ALPHABET = 2048  # digits of names
BASE = 3 << 20  # up to so many names are sorted at once
GROUPS = 32  # of characters, in a queue with many
Block = tuple[np.ndarray, np.ndarray]


class Spool:
    """Blocks of (suffix, common prefix) by key, in the order they came; beyond limit bytes in a temporary file."""

    def __init__(self, limit: int, kind: type):
        self.limit, self.kind = limit, np.dtype(kind)
        self.held, self.spilled, self.file = 0, 0, None
        self.blocks: dict[int, deque] = {}

    def put(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks.setdefault(key, deque()).append((pos, lcp))
        self.held += len(pos)
        if self.held * (self.kind.itemsize + 1) > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for key, blocks in self.blocks.items():
            live = [b for b in blocks if b[1] is not None]
            if not live:
                continue
            pos, lcp = _joined(live)
            at = self.file.tell()
            self.file.write(pos.astype(self.kind, copy=False).tobytes())
            self.file.write(lcp.tobytes())
            self.spilled += len(pos)
            self.blocks[key] = deque([*(b for b in blocks if b[1] is None), ((at, 0, len(pos), len(pos)), None)])
        self.held = 0

    def _read(self, at: int, lo: int, hi: int, n: int) -> Block:
        size = self.kind.itemsize
        self.file.seek(at + lo * size)
        pos = np.frombuffer(self.file.read((hi - lo) * size), self.kind)
        self.file.seek(at + n * size + lo)
        return pos, np.frombuffer(self.file.read(hi - lo), np.uint8)

    def _next(self, blocks: deque, most: int, last: bool) -> Block:
        """The first (last) block of a deque, or as much of it as `most` entries."""
        pos, lcp = blocks.pop() if last else blocks.popleft()
        if lcp is None:
            at, lo, hi, n = pos
            cut = max(lo, hi - most) if last else min(hi, lo + most)
            if lo < cut < hi:
                blocks.append(((at, lo, cut, n), None)) if last else blocks.appendleft(((at, cut, hi, n), None))
            return self._read(at, cut, hi, n) if last and cut > lo else self._read(at, lo, cut if not last else hi, n)
        self.held -= len(pos)
        return pos, lcp

    def drain(self, key: int, most: int) -> Iterator[Block]:
        """The blocks of a key, small ones together; what is put there meanwhile comes too."""
        while blocks := self.blocks.get(key):
            out, n = [], 0
            while blocks and n < most:
                out.append(self._next(blocks, most, False))
                n += len(out[-1][0])
            yield _joined(out)
        self.blocks.pop(key, None)

    def backwards(self, key: int, most: int) -> Iterator[Block]:
        """The blocks of a key from the last entry to the first; the common prefix of each is that with the one that followed it, 0 for the last."""
        after = 0
        while blocks := self.blocks.get(key):
            out, n = [], 0
            while blocks and n < most:
                out.append(self._next(blocks, most, True))
                n += len(out[-1][0])
            pos, lcp = _joined(out[::-1])
            yield pos[::-1], np.concatenate([[after], lcp[:0:-1]]).astype(np.uint8)
            after = lcp[0]
        self.blocks.pop(key, None)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _joined(blocks: list[Block]) -> Block:
    if len(blocks) == 1:
        return blocks[0]
    return np.concatenate([p for p, _ in blocks]), np.concatenate([x for _, x in blocks])


def array(n: int, kind, limit: int) -> np.ndarray:
    """An array of zeros; mapped from a temporary file if it has more than limit bytes."""
    kind = np.dtype(kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,)) if n * kind.itemsize > limit else np.zeros(n, kind)


def _range_minimum(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(lcp[a + 1 .. b]) for each pair, a < b: by doubled windows, one level held at a time."""
    out = np.empty(len(a), np.uint8)
    level = np.frexp((b - a).astype(np.float64))[1] - 1  # floor of the logarithm
    by = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by], np.arange(int(level.max(initial=-1)) + 2))
    at, size = lcp, 1
    for k in range(len(cuts) - 1):
        of = by[cuts[k] : cuts[k + 1]]
        if len(of):
            out[of] = np.minimum(at[a[of] + 1], at[b[of] - size + 1])
        if k + 2 < len(cuts):
            at = np.minimum(at[:-size], at[size:])
            size *= 2
    return out


def _one_more(lcp: np.ndarray) -> np.ndarray:
    return np.where(lcp == SAME, lcp, np.minimum(lcp, CAP - 1) + 1).astype(np.uint8)


class _Sweep:
    """One sweep: a queue by character and, for each, the smallest common prefix scanned since something was put there.

    With many characters, what is put in waits by groups of them, and is dealt out by character when the sweep comes to its group.
    """

    def __init__(self, text: np.ndarray, size: int, limit: int, kind, step: int):
        self.text, self.step, self.least = text, step, np.full(size, SAME, np.uint8)
        self.queue, self.far = Spool(limit // 2, kind), Spool(limit // 2, kind)
        self.width, self.group = (size // GROUPS + 1 if size > 10 * GROUPS else 0), -1

    def drain(self, c: int) -> Iterator[Block]:
        """What is in the queue for a character, in order; what is put there meanwhile comes too."""
        if self.width and c // self.width != self.group:
            self.group = c // self.width
            for pos, lcp in self.far.drain(self.group, self.step):
                d = self.text[pos]
                by = np.argsort(d, kind="stable")
                self._deal(d[by], pos[by], lcp[by])
        yield from self.queue.drain(c, self.step)

    def _deal(self, d: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Put entries, sorted by character, where they wait."""
        cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]]))
        keys = d[cuts[:-1]]
        if self.width:
            groups = keys // self.width
            near = groups == self.group
            for k, i, j in zip(keys[near].tolist(), cuts[:-1][near].tolist(), cuts[1:][near].tolist(), strict=True):
                self.queue.put(k, pos[i:j], lcp[i:j])
            change = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
            for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
                if not near[a]:
                    self.far.put(int(groups[a]), pos[cuts[a] : cuts[b]], lcp[cuts[a] : cuts[b]])
            return
        for k, i, j in zip(keys.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.queue.put(k, pos[i:j], lcp[i:j])

    def close(self) -> int:
        """Free the files; how many entries went there."""
        self.queue.close(), self.far.close()
        return self.queue.spilled + self.far.spilled

    def induce(self, pos: np.ndarray, lcp: np.ndarray, c: int, wanted) -> None:
        """Put in what a scanned block (of suffixes that begin with c) induces: the suffixes to the left whose characters d are wanted(d)."""
        before = self.text[pos - 1].astype(np.int32)  # of the first suffix: any; it is masked
        where = np.flatnonzero(wanted(before) & (pos > 0))
        lowest = np.minimum.accumulate(lcp)
        if len(where):
            d = before[where].astype(np.uint16)
            by = np.argsort(d, kind="stable")
            where, d = where[by], d[by]
            new = np.empty(len(where), np.uint8)
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            follows = np.ones(len(where), bool)
            follows[first] = False
            follows = np.flatnonzero(follows)
            new[first] = np.minimum(self.least[d[first]], lowest[where[first]])
            if len(follows):
                new[follows] = _range_minimum(lcp, where[follows - 1], where[follows])
            new = _one_more(new)
            left = (pos[where] - 1).astype(self.queue.kind)
            ends = np.append(first[1:], len(d))
            np.minimum(self.least, lowest[-1], out=self.least)
            rest = np.minimum.accumulate(lcp[::-1])[::-1]
            last = where[ends - 1]
            self.least[d[first]] = np.where(last + 1 < len(lcp), rest[np.minimum(last + 1, len(lcp) - 1)], SAME)
            self._deal(d, left, new)
        else:
            np.minimum(self.least, lowest[-1], out=self.least)


class _Level:
    """The sorting of one text (characters from 1 to size - 1, in uint16)."""

    def __init__(self, text: np.ndarray, size: int, limit: int, alphabet: int, base: int, log: dict):
        self.n, self.size, self.limit, self.alphabet, self.base, self.log = len(text), size, limit, alphabet, base, log
        self.text = text
        self.kind = np.int32 if self.n < (1 << 31) - 2 else np.int64
        self.step = max(1 << 10, limit // 64)
        self.piece = 8 * self.step  # of the text, read in its own order
        counts = np.zeros(size, np.int64)
        for lo in range(0, self.n, self.piece):
            counts += np.bincount(text[lo : lo + self.piece], minlength=size)
        self.chars = np.flatnonzero(counts).tolist()

    def run(self, i: int) -> int:
        """How often the character at i follows itself, from there; up to CAP."""
        own = self.text[i : i + CAP]
        other = np.flatnonzero(own != own[0])
        return int(other[0]) if len(other) else len(own)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """S* positions, ascending, the end among them, and the length of the run that begins there."""
        n, text, most = self.n, self.text, self.n // 2 + 2
        pos, runs = (array(most, self.kind, self.limit) for _ in range(2))
        at = most - 1
        pos[at], runs[at] = n, 0
        border, rising, character = n, True, 0  # where the next run begins, whether what lies there is small, its character
        for hi in range(n, 0, -self.piece):
            lo = max(0, hi - self.piece)
            own = text[lo:hi].astype(np.int32)
            follows = np.append(own[1:], character if hi == n else int(text[hi]))
            if hi == n:
                follows[-1] = 0
            change = np.flatnonzero(own != follows)
            # for each place: the first place after it with another character, and whether that is larger
            k = np.searchsorted(change, np.arange(len(own)))
            inside = k < len(change)
            j = change[np.minimum(k, len(change) - 1)] if len(change) else np.zeros(len(own), np.int64)
            nextp = np.where(inside, lo + j + 1, border)
            nextc = np.where(inside, follows[j] if len(change) else 0, character)
            small = np.where(inside, nextc > own, rising)
            before = np.concatenate([[int(text[lo - 1]) if lo else 0], own[:-1]])
            star = np.flatnonzero(small & (before > own))
            if len(star):
                at -= len(star)
                pos[at : at + len(star)], runs[at : at + len(star)] = lo + star, nextp[star] - lo - star
            border, rising, character = int(nextp[0]), bool(small[0]), int(nextc[0])
        return pos[at:], runs[at:]

    def strings(self, stars: np.ndarray, runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of S* positions, common prefixes with the one before, SAME for an equal one) in the order of their strings, one first character at a time."""
        index = Spool(self.limit, np.int64)
        for lo in range(0, len(stars) - 1, self.step):
            i = np.arange(lo, min(len(stars) - 1, lo + self.step))
            c = self.text[stars[i]]
            by = np.argsort(c, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], c[by][1:] != c[by][:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                index.put(int(c[by[a]]), i[by[a:b]], np.zeros(b - a, np.uint8))
        bits = max(1, int(self.size).bit_length())
        for c in sorted(index.blocks):
            yield self._ordered(np.concatenate([b for b, _ in index.drain(c, self.step)]), stars, runs, bits)
        index.close()

    def _ordered(self, i: np.ndarray, stars: np.ndarray, runs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The strings of S* positions number i in order: by 64-bit keys of as many characters as fit, and only those that tie by the next."""
        begin = stars[i].astype(np.int64)
        size = stars[i + 1] + runs[i + 1] + 1 - begin
        width = 64 // bits
        lcp = np.zeros(len(i), np.int64)
        order, tied, group, step = np.arange(len(i)), np.arange(len(i)), np.zeros(len(i), np.int64), 0
        while len(tied):
            of = order[tied]
            key = np.zeros(len(of), np.uint64)
            for k in range(step, step + width):
                at = begin[of] + k
                x = np.where((k < size[of]) & (at < self.n), self.text[np.minimum(at, self.n - 1)], 0).astype(np.uint64)
                key = (key << np.uint64(bits)) | x
            by = np.lexsort((key, group)) if step else np.argsort(key, kind="stable")
            order[tied], key = of[by], key[by]
            near = group[1:] == group[:-1]
            same = near & (key[1:] == key[:-1])
            differ = np.flatnonzero(near & ~same)
            shared = np.zeros(len(differ), np.int64)
            for k in range(1, width):
                far = np.uint64(bits * k)
                shared += (key[differ] >> far) == (key[differ + 1] >> far)
            lcp[tied[differ + 1]] = step + shared
            step += width
            # equal so far: they go on, or have ended, all of them alike
            ended = size[order[tied]] <= step
            lcp[tied[np.flatnonzero(same & ended[1:]) + 1]] = -1
            open_ = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & ~ended
            group = np.cumsum(np.concatenate([[0], ~same]))[open_]
            tied = tied[open_]
        return i[order], np.where(lcp < 0, SAME, np.minimum(lcp, CAP)).astype(np.uint8)

    def upwards(self, seeds: Spool) -> Spool:
        """The L suffixes by character, in order. seeds: the S* suffixes by character, in descending order."""
        sweep, done = _Sweep(self.text, self.size, self.limit, self.kind, self.step), Spool(self.limit, self.kind)
        sweep.induce(np.array([self.n], self.kind), np.zeros(1, np.uint8), 0, lambda d: d > 0)
        for c in self.chars:
            last = None
            for pos, lcp in sweep.drain(c):
                if last is None:
                    lcp = np.concatenate([[0], lcp[1:]]).astype(np.uint8)
                last = int(pos[-1])
                done.put(c, pos, lcp)
                sweep.induce(pos, lcp, c, lambda d, c=c: d >= c)
            for pos, lcp in seeds.backwards(c, self.step):
                if last is not None:
                    lcp = np.concatenate([[min(self.run(last), self.run(int(pos[0])), CAP)], lcp[1:]]).astype(np.uint8)
                    last = None
                sweep.induce(pos, lcp, c, lambda d, c=c: d > c)
        self._note(sweep.close() + done.spilled)
        return done

    def downwards(self, large: Spool) -> Iterator[Block]:
        """All suffixes in descending order but the empty one, with common prefixes with the one before."""
        sweep = _Sweep(self.text, self.size, self.limit, self.kind, self.step)
        for c in reversed(self.chars):
            last = None
            for pos, lcp in sweep.drain(c):
                if last is None:
                    lcp = np.concatenate([[0], lcp[1:]]).astype(np.uint8)
                last = int(pos[-1])
                yield pos, lcp
                sweep.induce(pos, lcp, c, lambda d, c=c: (d <= c) & (d > 0))
            for pos, lcp in large.backwards(c, self.step):
                if last is not None:
                    lcp[0] = min(self.run(last), self.run(int(pos[0])), CAP)
                    last = None
                yield pos, lcp
                sweep.induce(pos, lcp, c, lambda d, c=c: (d < c) & (d > 0))
        self._note(sweep.close())
        large.close()

    def _note(self, spilled: int) -> None:
        self.log["spilled"] = self.log.get("spilled", 0) + spilled

    def _some(self, blocks: Iterator[Block], keep) -> Iterator[Block]:
        """The entries for which keep(suffixes) holds, each with its common prefix with the kept one before."""
        least = SAME
        for pos, lcp in blocks:
            at = np.flatnonzero(keep(pos))
            if len(at):
                out = np.empty(len(at), np.uint8)
                out[0] = min(least, int(lcp[: at[0] + 1].min()))
                if len(at) > 1:
                    out[1:] = np.minimum.reduceat(lcp[: at[-1] + 1], at[:-1] + 1)
                rest = lcp[at[-1] + 1 :]
                least = int(rest.min()) if len(rest) else SAME
                yield pos[at], out
            elif len(lcp):
                least = min(least, int(lcp.min()))

    def sorted_stars(self) -> Iterator[Block]:
        """The S* suffixes but the end in descending order, with common prefixes."""
        stars, runs = self.stars()
        m = len(stars) - 1
        names, prefixes, kept, found = array(m + 1, np.int32, self.limit), [np.zeros(1, np.uint8)], Spool(self.limit, self.kind), 0
        for i, lcp in self.strings(stars, runs):
            fresh = lcp != SAME
            names[i] = found + np.cumsum(fresh)
            found += int(fresh.sum())
            prefixes.append(lcp[fresh])
            kept.put(0, stars[i].astype(self.kind), lcp)
        del runs
        self.log.setdefault("levels", []).append((self.n, m, found))
        if found == m:
            yield from kept.backwards(0, self.step)
            kept.close()
            return
        kept.close()
        prefix = np.concatenate(prefixes)  # prefix[i]: of the names i - 1 and i; the end has the name 0
        before = None
        for r, q in _at_once(names[:m]) if m <= self.base else self._deeper(names, m, found):
            above = np.concatenate([[before if before is not None else r[0]], r[:-1]])
            before = int(r[-1])
            own, other = np.minimum(r + q, m), np.minimum(above + q, m)
            same = stars[own].astype(np.int64) - stars[r]
            out = np.minimum(same, CAP).astype(np.uint8)
            short = np.flatnonzero((out < CAP) & (names[own] != names[other]))
            if len(short):
                a, b = names[own[short]].astype(np.int64), names[other[short]].astype(np.int64)
                more = _range_minimum(prefix, np.minimum(a, b), np.maximum(a, b))
                out[short] = np.minimum(same[short] + more, CAP)
            yield stars[r], out

    def _deeper(self, names: np.ndarray, m: int, found: int) -> Iterator[Block]:
        """The suffixes of the names in descending order, with common prefixes in names: the text of their digits is sorted in turn."""
        for most in (self.alphabet, 1 << 16):  # a text that would not become shorter gets larger digits, and fewer
            digits = max(1, math.ceil(math.log(found + 1) / math.log(most - 2)))
            if m * digits <= 0.7 * self.n:
                break
        base = found + 1 if digits == 1 else math.ceil((found + 1) ** (1 / digits))
        while base**digits < found + 1:
            base += 1
        shorter = array(m * digits, np.uint16, self.limit)
        for lo in range(0, m, self.piece):
            name = names[lo : min(m, lo + self.piece)].astype(np.int64)
            for k in range(digits):
                shorter[lo * digits + k : (lo + len(name)) * digits : digits] = name // base ** (digits - 1 - k) % base + 1
        deeper = _descending(shorter, base + 1, self.limit, self.alphabet, self.base, self.log)
        for pos, lcp in self._some(deeper, lambda pos: pos % digits == 0):
            yield (pos // digits).astype(np.int64), lcp.astype(np.int64) // digits

    def descending(self) -> Iterator[Block]:
        seeds = Spool(self.limit, self.kind)
        for pos, lcp in self.sorted_stars():
            c = self.text[pos]
            cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                seeds.put(int(c[a]), pos[a:b].astype(self.kind), lcp[a:b])
        large = self.upwards(seeds)
        self._note(seeds.spilled)
        seeds.close()
        yield from self.downwards(large)


def _at_once(names: np.ndarray) -> Iterator[Block]:
    """The suffixes of a short string of names in descending order, by ranks of doubled prefixes (only ties are sorted again), with common prefixes in names up to CAP // 2, which
    are CAP characters or more."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    new = np.concatenate([[True], names[order][1:] != names[order][:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start + 1
    have = 1
    while len(at := np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))):
        tied = order[at]
        key = rank[tied] * (n + 2) + np.where(tied + have < n, rank[np.minimum(tied + have, n - 1)], 0)
        by = np.argsort(key, kind="stable")
        order[at], key = tied[by], key[by]
        new[at[1:]] |= key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[at]] = start[at] + 1
        have *= 2
    del rank, new, start
    order = order[::-1]
    text = Sequence(mix(names.astype(np.uint64) + np.uint64(1)), np.minimum(n - np.arange(n), CAP // 2))
    for lo in range(0, n, 1 << 18):
        some = order[lo : lo + (1 << 18)]
        above = np.concatenate([[order[lo - 1] if lo else some[0]], some[:-1]])
        q = text.common(above, text, some)
        if not lo:
            q[0] = 0
        yield some, q


def _descending(text: np.ndarray, size: int, limit: int, alphabet: int, base: int, log: dict) -> Iterator[Block]:
    if not len(text):
        return
    yield from _Level(text, size, limit, alphabet, base, log).descending()


def descending(text: np.ndarray, limit: int = 64 << 20, alphabet: int = ALPHABET, base: int = BASE, log: dict | None = None) -> Iterator[Block]:
    """Blocks of the suffixes of text (uint16, characters from 1 on) in descending order, each with its common prefix with the suffix before it (up to CAP).

    log, if given, gets `spilled` (entries that went to disk) and `levels` (length, S* suffixes and names of each recursion).
    """
    return _descending(text, int(text.max(initial=0)) + 1, limit, alphabet, base, {} if log is None else log)


def suffix_lcp(text: np.ndarray, limit: int = 64 << 20, **how) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in ascending order, and each one's common prefix with the one before: the whole result in memory, for short texts."""
    blocks = list(descending(text, limit, **how))
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    pos, lcp = _joined(blocks)
    return pos[::-1].astype(np.int64), np.concatenate([[0], lcp[:0:-1]]).astype(np.uint8)

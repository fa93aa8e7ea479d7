"""The buffers, hashes and suffix arrays under the operators."""

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import corpus
from tidemill.llm.flat import BASE, PUNCT, SPACE, LOWER, U, Words, buffers, chunks, minimizers, powers, windows
from tidemill.llm.induced import suffix_lcp


def test_powers_are_exact():
    assert powers(5000)[4321] == pow(BASE, 4321, 1 << 64) and BASE % 2


def test_words_match_the_patterns():
    texts = [*corpus.texts(3), "a", " b", "c ", "d e"]
    data, at = buffers(pa.array(texts))
    for separators, pattern, fold in ((SPACE, corpus.SPACED, lambda t: t), (PUNCT, corpus.LETTERED, corpus.lower)):
        w = Words(LOWER[data] if separators is PUNCT else data, at, separators)
        want = [pattern.findall(fold(t or "")) for t in texts]
        got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first, w.first[1:])]
        assert got == want
        by = {}
        for h, word in zip(w.hashes().tolist(), sum(want, [])):
            assert by.setdefault(word, h) == h
        assert len(set(by.values())) == len(by)


def test_chunks_keep_every_row_whole():
    batch = pa.record_batch({"id": list(range(7)), "text": ["x" * n for n in (0, 10, 300, 1, 2, 90, 0)]})
    parts = list(chunks(batch, "text", 100))
    assert sum((p.column(0).to_pylist() for p, _, _ in parts), []) == list(range(7))
    assert [len(d) for _, d, _ in parts if len(d) > 100] == [300] or max(len(d) for _, d, _ in parts) >= 300


@pytest.mark.parametrize("width", [1, 2, 5, 8, 35])
def test_window_hashes_tell_windows_apart(width):
    v = np.random.default_rng(width).integers(0, 3, 400).astype(U)
    w = windows(v, width)
    by = {}
    for i, h in enumerate(w.tolist()):
        assert by.setdefault(tuple(v[i : i + width].tolist()), h) == h
    assert len(set(by.values())) == len(by) and len(w) == 400 - width + 1


def test_minimizers_are_leftmost_and_local():
    g = np.random.default_rng(0).integers(0, 50, 500).astype(U) << U(50)
    got = minimizers(g, 17)
    assert got.tolist() == [i + int(np.argmin(g[i : i + 17])) for i in range(500 - 16)]


@pytest.mark.parametrize("seed", range(60))
def test_induced_sorting(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(1, int(rng.integers(2, 8)), int(rng.integers(1, 150))).astype(np.uint16)
    t = np.concatenate([t, t[: len(t) // 2], t]) if seed % 3 == 0 else t
    order, lcp = suffix_lcp(t, limit=64 if seed % 2 else 1 << 20)
    s = t.tolist()
    want = sorted(range(len(s)), key=lambda i: s[i:])
    assert order.tolist() == want
    for a, b, n in zip(want, want[1:], lcp[1:].tolist()):
        assert s[a : a + n] == s[b : b + n] and (n == 250 or s[a + n : a + n + 1] != s[b + n : b + n + 1])

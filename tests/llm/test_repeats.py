"""Operators 3 and 4 against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from data import documents, empty, rows

from blotter.llm import substring_dedup, suffix_dedup


def covered(n, starts, length):
    flags = [False] * n
    for s in starts:
        flags[s:s + length] = [True] * length
    return flags


def brute_bytes(table):
    docs = [(i, (t or "").encode()) for i, t, *_ in table]
    seen = Counter(b[s:s + 200] for _, b in docs for s in range(len(b) - 199))
    out = []
    for i, b in docs:
        gone = covered(len(b), [s for s in range(len(b) - 199) if seen[b[s:s + 200]] > 1], 200)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(table):
    docs = [(i, (t or "").encode().split()) for i, t, *_ in table]
    first = {}
    for i, w in docs:
        for s in range(len(w) - 49):
            k = tuple(w[s:s + 50])
            first[k] = min(first.get(k, 1 << 63), 1 << 62 if i is None else i)
    out = []
    for i, w in docs:
        own = 1 << 62 if i is None else i
        gone = covered(len(w), [s for s in range(len(w) - 49) if first[tuple(w[s:s + 50])] < own], 50)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most,clashes", [(4000, True), (2, False)])
def test_bytes(spark, monkeypatch, most, clashes):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    got = suffix_dedup.remove_repeats(documents(spark, clashes=clashes)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(rows())


@pytest.mark.parametrize("most,clashes", [(4000, True), (2, False)])
def test_words(spark, monkeypatch, most, clashes):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    got = substring_dedup.remove_repeats(documents(spark, clashes=clashes)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_words(rows())


def test_empty_tables(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_runs_span_segments(monkeypatch):
    """Cutting the units in segments loses and doubles no window."""
    from blotter.llm import anchors
    rng = np.random.default_rng(1)
    units = rng.integers(0, 4, 5000).astype(np.uint8)
    border = np.array([0, 0, 10, 700, 700, 3000, 5000])
    for segment in (64, 300, 1 << 18):
        monkeypatch.setattr(anchors, "SEGMENT", segment)
        _, doc, start, n = anchors.runs(units, border, 200, 64)
        at = sorted((int(d), int(s) + k) for d, s, c in zip(doc, start, n) for k in range(c))
        want = [(d, s) for d in range(6) for s in range(border[d + 1] - border[d] - 199)]
        assert at == want


def test_cover_meets_every_difference():
    assert (suffix_dedup.SHIFT >= 0).all() and suffix_dedup.SHIFT.max() < suffix_dedup.PERIOD


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(monkeypatch, seed):
    """Block by block, the suffixes come in the order of their 200 bytes (repetitive strings, long ties)."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50)
    rng = np.random.default_rng(seed)
    strings = [bytes(rng.integers(97, 99, rng.integers(200, 330)).astype(np.uint8)) for _ in range(3)]
    strings += [b"ab" * 150, b"a" * 260, strings[0][:240] + b"zz", b"x" + strings[0][3:230]]
    got = suffix_dedup.repeated_in(strings, [1] * len(strings))
    seen = Counter(s[k:k + 200] for s in strings for k in range(len(s) - 199))
    for s, ranges in zip(strings, got):
        flags = [False] * (len(s) - 199)
        for a, b in zip(ranges[::2], ranges[1::2]):
            flags[a:b] = [True] * (b - a)
        assert flags == [seen[s[k:k + 200]] > 1 for k in range(len(s) - 199)]

"""FM-index over a sequence of integer symbols, with vectorised backward search."""

from __future__ import annotations

import numpy as np


class WaveletRanks:
    """Wavelet matrix: ``rank(c, i)`` counts symbol ``c`` before position ``i``."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []  # ones before each position, a level at a time
        self.zeros: list[int] = []
        cur = seq
        for b in range(self.bits - 1, -1, -1):
            bit = (cur >> b) & 1
            ones = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        first = np.zeros_like(i)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            up = ((c >> b) & 1) == 1
            i = np.where(up, zeros + ones[i], i - ones[i])
            first = np.where(up, zeros + ones[first], first - ones[first])
        return i - first

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position and its rank there, in one descent."""
        c = np.zeros_like(i)
        first = np.zeros_like(i)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            up = ones[i + 1] > ones[i]
            c = (c << 1) | up
            i = np.where(up, zeros + ones[i], i - ones[i])
            first = np.where(up, zeros + ones[first], first - ones[first])
        return c, i - first


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` (whose last symbol is its unique smallest), by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and locate over ``text``; symbols are 1 or more, 0 is the end mark."""

    def __init__(self, text: np.ndarray, sample: int = 16):
        text = np.append(text, 0).astype(np.int64)
        sa = suffix_array(text)
        self.n = len(text)
        self.sigma = int(text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        self.ranks = WaveletRanks(text[sa - 1], self.sigma)
        self.sample = sample
        # Rows of sampled suffixes: every `sample`-th text position, and the first.
        rows = np.flatnonzero(sa % sample == 0)
        self.sampled = np.zeros(self.n, bool)
        self.sampled[rows] = True
        self.sample_no = np.cumsum(self.sampled) - 1
        self.sample_at = sa[rows]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of many phrases at once; ``phrases`` is right-aligned, one row each."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for k in range(1, width + 1):
            live = np.flatnonzero((length >= k) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, width - k]
            known = (c > 0) & (c < self.sigma)
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live] = self.before[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.before[c] + self.ranks.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: step back to the nearest sampled suffix."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            c, r = self.ranks.access(rows[todo])
            rows[todo] = self.before[c] + r
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.sample_at[self.sample_no[rows]] + steps

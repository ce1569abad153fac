"""FM-index over a sequence of word ids: suffix array, Burrows-Wheeler
transform, wavelet matrix ranks, backward search and location by sampled
suffix positions, all vectorised over many patterns at once.

Id 0 separates runs and matches nothing; words have ids from 1.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``seq`` by prefix doubling. Separators differ
    from each other (earlier is smaller) and are smaller than any word, so no
    comparison goes past one."""
    n = len(seq)
    seps = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(seps)
    rank[seps] = np.arange(len(seps))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank = new
        step *= 2
        if n == 0 or rank[order[-1]] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """rank(c, i): how often c stands before i, in one pass over the bits of c."""

    def __init__(self, seq: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones: list[np.ndarray] = []
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
        lo = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[lo], ones[i]
            lo = np.where(bit, zeros + a, lo - a)
            i = np.where(bit, zeros + b, i - b)
        return i - lo


class FMIndex:
    def __init__(self, seq: np.ndarray, largest: int, every: int = 8):
        """``seq`` must start with a separator; every ``every``-th position and
        each position behind a separator keeps its suffix position."""
        n = len(seq)
        sa = suffix_array(seq)
        self.n = n
        self.bwt = seq[sa - 1]  # of the first position: the last symbol
        self.tree = WaveletMatrix(self.bwt, largest)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=largest + 1))]).astype(np.int64)
        self.marked = (sa % every == 0) | (self.bwt == 0)
        self.sampled = sa[self.marked]
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows, padded on the right): the
        half-open suffix interval of each; empty if it doesn't occur."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for k in range(int(lengths.max(initial=0))):
            act = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(act):
                break
            c = patterns[act, lengths[act] - 1 - k].astype(np.int64)
            lo[act] = self.before[c] + self.tree.rank(c, lo[act])
            hi[act] = self.before[c] + self.tree.rank(c, hi[act])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back with LF to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        cur, left = rows.astype(np.int64), np.arange(len(rows))
        while len(left):
            done = self.marked[cur]
            out[left[done]] = self.sampled[self.mark_rank[cur[done]]] + steps[left[done]]
            left, cur = left[~done], cur[~done]
            if len(left):
                c = self.bwt[cur].astype(np.int64)
                cur = self.before[c] + self.tree.rank(c, cur)
                steps[left] += 1
        return out

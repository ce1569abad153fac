"""Repeated windows of a set of strings by threshold-bounded interval expansion
on their Burrows-Wheeler transform.

``repeated_starts`` finds every position where a string of ``length`` bytes
starts that also starts elsewhere in the set (or in a string of weight two or
more, which stands for several copies).

The intervals of all strings of 0, 1, 2, ... bytes are expanded breadth-first by
backward extension: each interval is extended by every byte that stands before
its suffixes, and the right end of an extended interval, if seen for the first
time, is a place where the common prefix of neighbouring suffixes is exactly the
current value. Common prefixes come out by increasing value, so the expansion
stops at ``length``: neighbours without a value by then share at least that many
bytes.
"""

from __future__ import annotations

import numpy as np


def _order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` bytes at least (prefix doubling)."""
    n = len(text)
    key = text.astype(np.uint64)
    for step in (1, 2, 4):
        nxt = np.zeros(n, np.uint64)
        nxt[: max(0, n - step)] = key[step:]
        key = (key << np.uint64(8 * step)) | nxt
    have = 8
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        s = key[order]
        new = np.ones(n, bool)
        new[1:] = s[1:] != s[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        if int(rank[order[-1]]) == n:
            return order
        nxt = np.zeros(n, np.uint64)
        nxt[: max(0, n - have)] = rank[have:]
        key = (rank << np.uint64(32)) | nxt
        have *= 2


def _expand(bwt: np.ndarray, lf: np.ndarray, length: int) -> np.ndarray:
    """True at rows that share fewer than ``length`` bytes with the row before."""
    n = len(bwt)
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    change = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
    run_start = np.concatenate([[0], change])
    run_end = np.concatenate([change, [n]]) - 1
    run_of = np.zeros(n, np.int32)
    run_of[change] = 1
    run_of = np.cumsum(run_of, dtype=np.int32)
    lb, rb = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for value in range(length):
        if not len(lb):
            break
        first, last = run_of[lb], run_of[rb]
        many = first != last
        # one run: one extension; several: the first and last row of each byte
        one = ~many
        s, e = lb[one], rb[one]
        if many.any():
            f, k = first[many].astype(np.int64), (last[many] - first[many] + 1).astype(np.int64)
            owner = np.repeat(np.arange(len(k)), k)
            run = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(f, k)
            a = np.maximum(run_start[run], lb[many][owner])
            b = np.minimum(run_end[run], rb[many][owner])
            key = (owner << 8) | bwt[a]
            order = np.argsort(key, kind="stable")
            key = key[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            tail = np.append(head[1:], True)
            s, e = np.concatenate([s, a[order[head]]]), np.concatenate([e, b[order[tail]]])
        if value:  # nothing longer than the separator itself is needed behind one
            on = bwt[s] != 0
            s, e = s[on], e[on]
        lo, hi = lf[s], lf[e]
        fresh = ~cut[hi + 1]
        # the last interval's end is known, but its inside still has to be expanded
        if value == 0:
            fresh |= hi + 1 == n
        lb, rb = lo[fresh], hi[fresh]
        cut[rb + 1] = True
    return cut[:n]


def repeated_starts(strings: list[np.ndarray], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each byte string: a mask of its starts that repeat. Bytes are UTF-8,
    so adding one to them frees 0 for the separators."""
    sizes = np.array([len(s) for s in strings], np.int64)
    total = int(sizes.sum()) + len(strings)
    text = np.zeros(total, np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    place = np.ones(total, bool)
    place[begin + sizes] = False
    text[place] = np.concatenate(strings) + np.uint8(1)
    sa = _order(text, length)
    bwt = text[sa - 1]
    lf = np.empty(total, np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(total)
    group = np.cumsum(_expand(bwt, lf, length)) - 1
    starts = np.maximum(sizes - length + 1, 0)
    weight = np.zeros(total, np.int64)
    at = np.repeat(begin, starts) + np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
    weight[at] = np.repeat(weights, starts)
    count = np.bincount(group, weight[sa])
    mark = np.zeros(total, bool)
    mark[sa] = (count >= 2)[group]
    ends = np.cumsum(starts)
    return np.split(mark[at], ends[:-1])

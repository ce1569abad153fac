"""Canonical length-limited Huffman codes over integer ids, with vectorised
encoding and table-driven decoding of independent lanes.

Code lengths come from package-merge; the code is canonical (shorter codes
first, equal lengths by id), so the lengths alone describe it.
"""

from __future__ import annotations

import numpy as np

MAX_BITS = 20


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 for ids not in use."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    if n <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    rows, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = rows[: len(rows) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        rows = both[at]
        is_leaf.append(at < n)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(is_leaf):
        leaf = int(flags[:take].sum())
        depth[:leaf] += 1
        take = 2 * (take - leaf)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words, right-aligned."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    ln = lengths[order].astype(np.int64)
    top = int(ln.max(initial=0))
    step = np.int64(1) << (top - ln)
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = ((np.cumsum(step) - step) >> (top - ln)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every prefix of ``bits`` bits: the id and its code length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    ln = lengths[order].astype(np.int64)
    bits = int(ln.max(initial=1))
    span = np.int64(1) << (bits - ln)
    ids, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    total = int(span.sum())
    ids[:total], size[:total] = np.repeat(order, span), np.repeat(ln, span)
    return ids, size, bits


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Bit stream (most significant bit first), the bit offset of each id, and the number of bits."""
    ln = lengths[ids].astype(np.int64)
    ends = np.cumsum(ln)
    bits = int(ends[-1]) if len(ids) else 0
    start = ends - ln
    out = np.zeros(bits // 64 + 2, np.uint64)
    if len(ids):
        word, shift = start >> 6, 64 - (start & 63) - ln
        code = codes[ids]
        high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.add.reduceat(high, first)
        over = np.flatnonzero(shift < 0)
        out[word[over] + 1] += code[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (bits + 7) // 8], start, bits


def decode(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Ids of independent lanes: lane k reads counts[k] ids from bit starts[k];
    all lanes step together. Lanes follow each other in the result."""
    ids, size, bits = table
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
    total = int(counts.sum())
    out = np.zeros(total, np.uint32)
    order = np.argsort(-counts, kind="stable")  # lanes that end early are at the end
    pos, at, left = starts[order].astype(np.int64), (np.cumsum(counts) - counts)[order], counts[order]
    drop = np.uint32(32 - bits)
    active = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), "left")  # lanes with more than k ids
    for k, n in enumerate(active):
        p = pos[:n]
        peek = (window[p >> 3] << (p & 7).astype(np.uint32)) >> drop
        out[at[:n] + k] = ids[peek]
        pos[:n] = p + size[peek]
    return out

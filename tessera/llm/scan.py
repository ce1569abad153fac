"""Vectorised scanning of text columns inside Python tasks.

A text column of an Arrow batch is one contiguous UTF-8 buffer with offsets;
the helpers here find words and hash words, shingles and fixed-length windows
over such a buffer with numpy, without a Python loop over words or bytes.
Buffers are handled in slices of about ``SLICE_BYTES``; one longer text makes a
slice of its own, because no text is ever cut.

Hashes are 64 bits: a polynomial over a random byte table modulo 2**64,
followed by a mixing step. Equal input always gives equal hashes. A collision
can change a result where an operator decides by one hash alone; the README
says where that is and where bytes or two hashes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240607)
BYTE_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
SHINGLE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of the bytes outside the given inclusive ranges."""
    t = np.ones(256, dtype=bool)
    for a, b in ranges:
        t[a : b + 1] = False
    return t


#: Words are runs of anything but ASCII white space.
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_powers = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i in 0..n-1."""
    if len(_powers["pow"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        with np.errstate(over="ignore"):
            for name, b in (("pow", BASE), ("inv", BASE_INV)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
    return _powers["pow"][:n], _powers["inv"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * MIX[0]
        h = (h ^ (h >> np.uint64(27))) * MIX[1]
        return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into (first row, last row, bytes, offsets) slices of
    about ``limit`` bytes. Null texts are empty; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may keep bytes under it
        lengths = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        if (lengths != np.diff(offsets)).any():
            yield from text_slices(column.fill_null(""), limit)
            return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of table[byte] * BASE**position over [i, j)."""
    p = np.empty(len(buf) + 1, np.uint64)
    p[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_TABLE[buf] * powers(len(buf))[0], out=p[1:])
    return p


def span_hash(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Mixed hash of the bytes [s, e), wherever they stand."""
    inv = powers(len(p))[1]
    with np.errstate(over="ignore"):
        return mix((p[e] - p[s]) * inv[s] + (e - s).astype(np.uint64))


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first
    word (one more entry at the end). Words never cross texts."""
    n = len(buf)
    w = table[buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash of each lower-cased word, word starts, word ends, first word of each text)."""
    low = LOWER[buf]
    s, e, at = words(low, offsets, table)
    return span_hash(prefix_hash(low), s, e), s, e, at


def runs_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of h; len(h) - k + 1 values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += h[j : j + n] * SHINGLE[j % len(SHINGLE)] + np.uint64(j)
            if j % len(SHINGLE) == len(SHINGLE) - 1:
                out = mix(out)
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over every w consecutive entries, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out

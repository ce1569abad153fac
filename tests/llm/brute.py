"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = SPACED.findall(low(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def roots(nodes: list, links: list[tuple]) -> dict:
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def jaccard(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), comparing every pair."""
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = roots(list(sets), links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                hit[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~hit])
        out.append((len(d), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def best_fit_sequences(lengths: list[int], capacity: int) -> int:
    """Sequences that plain best-fit decreasing opens."""
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= x]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids(tok: Tokenizer, text: str | None) -> list[int]:
    return tok.encode(text or "", add_special_tokens=False).ids


def crc_ids(values: list[int]) -> int:
    return zlib.crc32(np.array(values, "<u4").tobytes())


def near_vectors(rows: list[tuple], threshold: float) -> dict[int, tuple[int, int]]:
    """vec_id -> (n_links, component_id), comparing every pair of a label."""
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    links = []
    for (a, x, p), (b, y, q) in itertools.combinations(rows, 2):
        if p == q and good(x, p) and good(y, q) and len(x) == len(y):
            u, v = np.array(x, float), np.array(y, float)
            if u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                links.append((a, b))
    comp = roots([r[0] for r in rows], links)
    n = Counter(x for link in links for x in link)
    return {r[0]: (n[r[0]], comp[r[0]]) for r in rows}


def contamination(docs: list[tuple], items: list[tuple], window: int = 13) -> dict[int, tuple]:
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in docs:
        w = ALNUM.findall(low(text))
        hit, found = [False] * len(w), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    found |= windows[tuple(w[j : j + k])]
                    hit[j : j + k] = [True] * k
        n = sum(hit)
        listed = sorted(str(x) for x in found if x is not None)
        out[doc] = (len(w), n, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), n > 0 and 20 * n >= len(w))
    return out

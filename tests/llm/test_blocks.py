"""The search inside a block of op1, against all pairs, wherever the pivot stands."""

import itertools
import time

import numpy as np
import pytest

from tessera.llm import ngram_jaccard
from tests.llm import brute


def mixed(rng, n=120):
    bases = [rng.integers(1, 400, 60) for _ in range(3)]
    sets = []
    for _ in range(n):
        words = bases[rng.integers(0, 3)].copy()
        k = int(rng.integers(0, 14))
        words[rng.integers(0, 60, k)] = rng.integers(1, 400, k)
        sets.append(np.unique(words).astype(np.uint64))
    return sets


@pytest.mark.parametrize("large", [2, 5, 32])
@pytest.mark.parametrize("seed", range(6))
def test_block_links(monkeypatch, large, seed):
    monkeypatch.setattr(ngram_jaccard, "LARGE", large)
    rng = np.random.default_rng(seed)
    sets = mixed(rng)
    n = len(sets)
    pivot = int(rng.integers(0, 160))  # often not in the block
    is_query = np.ones(n, bool) if seed % 2 else rng.random(n) < 0.6
    is_query[pivot : pivot + 1] = True
    a, b, left = ngram_jaccard.block_links(np.arange(n), sets, is_query, pivot, 80)
    links = [(i, j) for i, j in itertools.combinations(range(n), 2)
             if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert set(map(tuple, np.sort(np.stack([a, b], 1), axis=1).tolist())) <= set(links)
    if is_query.all():
        got, want = brute.roots(list(range(n)), list(zip(a.tolist(), b.tolist()))), brute.roots(list(range(n)), links)
        assert got == want and len(set(want.values())) < n - 20
        assert left.tolist() == sorted(left) == [i for i in range(n) if pivot >= n or want[i] != want[pivot]]
    elif pivot >= n:  # every link with a query at an end
        asked = [x for x in links if is_query[list(x)].any()]
        assert brute.roots(list(range(n)), list(zip(a.tolist(), b.tolist()))) == brute.roots(list(range(n)), asked)


def test_near_copies_beside_a_foreign_pivot_are_not_searched_in_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    took = []
    for m in (256, 1024):
        group = [np.unique(np.concatenate([base[12:], rng.integers(1, 1 << 62, 12).astype(np.uint64)])) for _ in range(m)]
        sets = [np.unique(rng.integers(1, 1 << 62, 400).astype(np.uint64)), *group]
        begun = time.process_time()
        a, b, left = ngram_jaccard.block_links(np.arange(len(sets)), sets, np.ones(len(sets), bool), 0, 80)
        took.append(time.process_time() - begun)
        assert len(a) == m - 1 and len(left) == m
    assert took[1] < 10 * took[0] + 1  # pairs would take 16 times as long, from 3 s on

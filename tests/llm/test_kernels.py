"""The numpy parts of the corpus operators against plain Python."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bpe, bwt_repeats, fm_index, huffman, language_id, ngram_jaccard, packing, scan
from tessera.llm.components import local_roots
from tessera.llm.embedding_dedup import Quantised, linked_pairs
from tests.llm import brute

PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", ".", ",", "'s", "'ll", "'", "<|endoftext|>", "<|startoftext|>", "\x1c", " ", "　", "日本",
          "😀", "1", "23", "A", "Σ", "İ", "é", "́", "ᾳ", " ", "\x85", "\r\n", " a", "of", "the ", "The", "\0", "½", "²", "ǅ", "ʰ", "Ⅷ", "_", "—", " (", "x "]


def _texts(n: int, seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [None, "", " ", "  ", " ́a", "a ́b", " \n", "x\n \ny"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_encoder_equals_library(name):
    tok = brute.tokenizer(name)
    enc = bpe.ChunkEncoder(bpe.vocabulary_path(name))
    assert enc.mode != "whole" and enc.fast is not None
    texts = [*_texts(4000), *tok.get_vocab(), *(" " + tok.decode([i]) + " x" for i in range(0, tok.get_vocab_size(), 7))]
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for i, j, buf, offs in scan.text_slices(pa.array(texts), 1 << 16):
        got, at = enc.encode(buf, offs)
        assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == want[i:j]


def test_words_and_slices():
    texts = ["Ab c\td", None, "", " é x ", "one", "\x0b", "ende"]
    got = []
    for i, j, buf, offs in scan.text_slices(pa.array(texts), 4):
        s, e, at = scan.words(buf, offs, scan.NON_SPACE)
        got += [[buf[s[k] : e[k]].tobytes().decode() for k in range(at[t], at[t + 1])] for t in range(j - i)]
    assert got == [brute.SPACED.findall(t or "") for t in texts]


def test_interval_expansion_finds_repeats():
    rng = np.random.default_rng(3)
    pick = random.Random(2)
    for _ in range(300):
        length, letters = pick.choice([1, 2, 3, 5, 9, 20]), pick.choice([1, 2, 3, 26])
        base = rng.integers(97, 97 + letters, 60).astype(np.uint8)
        strings = []
        for _ in range(pick.randint(1, 6)):
            a, b = sorted(rng.integers(0, 61, 2))
            strings.append(base[a:b].copy() if pick.random() < 0.5 else rng.integers(97, 97 + letters, pick.randint(0, 50)).astype(np.uint8))
        weights = rng.integers(1, 3, len(strings)) if pick.random() < 0.3 else np.ones(len(strings), int)
        count = Counter()
        for s, w in zip(strings, weights):
            for i in range(len(s) - length + 1):
                count[s[i : i + length].tobytes()] += w
        want = [[count[s[i : i + length].tobytes()] >= 2 for i in range(len(s) - length + 1)] for s in strings]
        assert [g.tolist() for g in bwt_repeats.repeated_starts(strings, weights, length)] == want


def test_fm_index_search_and_locate():
    rng = np.random.default_rng(4)
    for _ in range(100):
        runs = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(rng.integers(1, 5))]
        seq = np.concatenate([np.concatenate([[0], r]) for r in runs]).astype(np.int32)
        index = fm_index.FMIndex(seq, 4, every=3)
        patterns = rng.integers(1, 5, (20, 4))
        lengths = rng.integers(1, 5, 20)
        lo, hi = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, lo, hi):
            want = [k for k in range(len(seq) - n + 1) if (seq[k : k + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_huffman_round_trip_and_limit():
    rng = np.random.default_rng(1)
    for _ in range(100):
        counts = rng.integers(0, 1000, rng.integers(1, 60)) ** rng.integers(1, 3)
        counts[rng.random(len(counts)) < 0.3] = 0
        limit = int(rng.integers(6, 12))
        lengths = huffman.code_lengths(counts, limit)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max(initial=0) <= limit
        if (counts > 0).sum() > 1:
            assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) == 1
        if counts.any():
            ids = rng.choice(np.flatnonzero(counts), rng.integers(0, 3000))
            stream, start, _ = huffman.encode(ids, lengths, huffman.canonical_codes(lengths))
            lanes = start[::16]
            n = np.minimum(16, len(ids) - 16 * np.arange(len(lanes)))
            assert (huffman.decode(np.frombuffer(stream, np.uint8), lanes, n, huffman.decode_table(lengths)) == ids).all()


def test_huffman_is_optimal_without_limit():
    import heapq

    counts = np.random.default_rng(8).integers(1, 500, 40)
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (huffman.code_lengths(counts, 20).astype(int) * counts).sum() == cost


def test_best_fit_equals_plain_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(100):
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        runs, sequences = packing.best_fit(Counter(lengths), capacity)
        assert sequences == brute.best_fit_sequences(lengths, capacity)
        placed = defaultdict(list)
        for x, n in Counter(lengths).items():
            for seq, off in zip(*packing.place(runs, np.full(n, x), np.arange(n))):
                placed[seq].append((off, x))
        for own in placed.values():
            end = 0
            for off, x in sorted(own):
                assert off == end
                end += x
            assert end <= capacity


def test_divide_skip_search_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        base = rng.integers(0, 60, 40).astype(np.uint64)
        sets = []
        for _ in range(rng.integers(2, 25)):
            s = base.copy()
            k = rng.integers(0, 8)
            s[rng.integers(0, 40, k)] = rng.integers(100, 200, k)
            sets.append(np.unique(s[: rng.integers(25, 41)]))
        lists = ngram_jaccard.InvertedLists(sets)
        for own, q in enumerate(sets):
            want = [m for m, s in enumerate(sets) if m != own and 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
            assert lists.search(own, q, 80).tolist() == want
        fps = np.arange(len(sets))
        a, b, _ = ngram_jaccard.block_links(fps, sets, np.ones(len(sets), bool), 0, 80)
        pairs = [(x, y) for x, y in itertools.combinations(range(len(sets)), 2)
                 if 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))]
        got = brute.roots(list(range(len(sets))), list(zip(a.tolist(), b.tolist())))
        assert got == brute.roots(list(range(len(sets))), pairs)


def test_quantised_products_lose_no_pair():
    rng = np.random.default_rng(7)
    for scale in (1e-150, 1.0, 1e150):
        x = rng.normal(size=(80, 24))
        x[1::2] = x[::2] + rng.normal(scale=rng.uniform(0.05, 0.5, (40, 1)), size=(40, 24))
        u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        want = set(zip(*np.nonzero(u @ u.T >= 0.93)))
        q = Quantised(x * scale)
        i, j = linked_pairs(q, q, 0.93)
        assert set(zip(i, j)) == want


def test_local_roots():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, n, (2, rng.integers(0, 40)))
        want = brute.roots(list(range(n)), list(zip(a.tolist(), b.tolist())))
        assert local_roots(n, a, b).tolist() == [want[k] for k in range(n)]


def test_kernel_is_shared_grams_over_geometric_mean():
    texts = ["abcab", "abc xyz", "", "99"]
    _, _, buf, offs = next(scan.text_slices(pa.array(texts)))
    x = language_id.presence(buf, offs)
    own = {t: {(n, t.encode()[i : i + n]) for n in language_id.GRAMS for i in range(len(t) - n + 1)} for t in texts[:2]}
    assert x[:2].sum(axis=1).tolist() == [len(own[t]) for t in texts[:2]]
    assert x[0] @ x[1] == len(own[texts[0]] & own[texts[1]])
    assert x[2].sum() == 0


def test_parity_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(0)
    ruled_out = 0
    for _ in range(80):
        sets = []
        for _ in range(rng.integers(1, 4)):
            n = int(rng.integers(1, 400))
            base = rng.integers(0, 1 << 62, n).astype(np.uint64)
            for _ in range(rng.integers(1, 5)):
                s = base.copy()
                k = rng.integers(0, max(1, n // 3))
                s[rng.integers(0, n, k)] = rng.integers(0, 1 << 62, k)
                sets.append(np.unique(s))
        n = np.array([len(s) for s in sets])
        bits = [np.frombuffer(p, np.uint64) for p in ngram_jaccard.parities(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n)]
        links = np.array([[i != j and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
        every = np.arange(len(sets))
        keep = ngram_jaccard.may_link(n, bits, every, every, 80)
        assert (keep >= links.any(axis=1)).all()
        ruled_out += int((~keep).sum())
        left, right = every[::2], every[1::2]
        assert (ngram_jaccard.may_link(n, bits, left, right, 80)[left] >= links[np.ix_(left, right)].any(axis=1)).all()
    assert ruled_out > 50

"""LM scoring on small tables against plain Python, the parts of the clustering
against brute force, and the edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_scoring as lm
from tests.llm import brute

SCHEMA = "doc_id long, text string, score string, held_out int, n int"


def held(col):
    return F.crc32(F.col(col).cast("string")) % 7 == 2


def texts(seed: int = 0, n: int = 150) -> list[tuple]:
    """Two sublanguages with frequent words, rare words, repeats, nulls, blanks and a long text."""
    rng = random.Random(seed)
    tongues = [[f"{p}{i}" for i in range(30)] for p in ("ka", "Le")]
    rows: list[str | None] = [None, "", " \t\n ", "One", "a " * 500, "x" * 5000]
    for k in range(n):
        words = tongues[k % 2]
        rows.append(rng.choice([" ", "  ", "\n"]).join(
            words[min(29, int(rng.expovariate(0.2)))] if rng.random() < 0.85 else f"rare{rng.randrange(400)}" for _ in range(rng.randint(1, 60))))
    rows += rng.choices(rows, k=10)
    return [(i if i != 20 else None, t, "clash", 1, 2) for i, t in enumerate(rows)]


def plain(rows: list[tuple]) -> tuple[dict, int, Counter]:
    """doc_id -> (held_out, tokens) of each row, N, counts."""
    docs = [(r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2, [*brute.SPACED.findall(brute.low(r[1])), None]) for r in rows]
    counts = Counter(w for _, h, ws in docs if not h for w in ws)
    return docs, sum(counts.values()), counts


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"core": 12, "common": 14, "classes": 5}, {"core": 4, "common": 4, "classes": 3, "rounds": 1}])
def test_scores(frame, sizes, monkeypatch):
    """Counts and base against plain Python; the score from the classes that the clustering gave."""
    seen: dict = {}
    true_others, true_cluster, true_core = lm.other_words, lm.cluster, lm.core_words
    monkeypatch.setattr(lm, "core_words", lambda *a: seen.setdefault("core", true_core(*a)))
    monkeypatch.setattr(lm, "cluster", lambda *a: seen.setdefault("cluster", true_cluster(*a)))

    def others(*a):
        got = true_others(*a)
        seen["others"] = [tuple(r) for r in got.collect()]
        return got

    monkeypatch.setattr(lm, "other_words", others)
    got = lm.score(frame, held, **sizes).collect()
    rows = texts()
    docs, total, counts = plain(rows)
    (words, n), (of, _) = seen["core"], seen["cluster"]
    assert n == total and len(words.h) + len(seen["others"]) == len(counts)
    keys = {(int(h), int(g)): int(of[i]) for h, g, i in zip(words.h, words.g, words.columns["id"])}
    keys |= {(h % 2**64, g % 2**32): c for h, g, _, c in seen["others"]}

    vocabulary = [w for w in counts if w is not None]
    _, _, h, g, _ = next(lm._tokens(pa.array([" ".join(vocabulary)]), True))
    cls = {w: keys[int(a), int(b)] for w, a, b in zip([*vocabulary, None], h, g)}
    size, pairs, single = Counter(), Counter(), Counter()
    for w, c in counts.items():
        size[cls[w]] += c
    for _, out, ws in docs:
        if not out:
            for a, b in zip([None, *ws], ws):
                pairs[cls[a], cls[b]] += 1
                single[cls[a]] += counts[b] == 1
    after = Counter(a for a, _ in pairs)
    from_ = Counter()
    for (a, _), c in pairs.items():
        from_[a] += c

    def chance(context, word):
        t, m = max(1, after[context]), from_[context]
        unknown = (single[context] + t / (total + len(counts) + 1)) / (m + t)
        if word not in counts:
            return unknown
        c = cls[word]
        return (1 - unknown) * (pairs[context, c] + t * size[c] / total) / (m + t) * counts[word] / size[c]

    for context in set(cls.values()):
        assert math.isclose(sum(chance(context, w) for w in counts) + chance(context, "never seen"), 1)
    want = []
    for i, out, ws in docs:
        context, value = cls[None], 0.0
        for w in ws:
            value += math.log10(chance(context, w))
            context = cls.get(w, context)
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws)
        want.append((str(i), out, len(ws), sum(w in counts for w in ws), total, round(base, 6), round(value, 6)))
    have = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    assert sorted(have) == sorted(want)
    if not sizes:  # better than the base on held-out texts
        out = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.1 * sum(r["n_tokens"] for r in out)


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(0)
    classes, size = 4, 12
    n = rng.integers(0, 9, (size, size))
    of = rng.integers(0, classes, size)

    def table(assigned):
        m = np.zeros((classes + 1, classes + 1))
        np.add.at(m, (assigned[:, None].repeat(size, 1), assigned[None, :].repeat(size, 0)), n)
        return m

    for w in range(size):
        rest = np.arange(size) != w
        left = np.bincount(of[rest], n[rest, w], classes + 1)
        right = np.bincount(of[rest], n[w, rest], classes + 1)
        m = table(of)
        lm._shift(m, of[w], left, right, n[w, w], -1)
        g = lm.gains(m, left, right, n[w, w], classes)
        real = []
        for c in range(classes):
            moved = of.copy()
            moved[w] = c
            real.append(lm.likelihood(table(moved)))
        assert np.allclose(g - g[0], np.array(real) - real[0])


def test_other_words_join_the_class_with_the_most_gain():
    rng = np.random.default_rng(1)
    m = rng.integers(1, 50, (6, 6)).astype(float)
    codes = np.array([0 * 256 + 2, 0 * 256 + 128 + 3, 1 * 256 + 5, 3 * 256 + 1, 3 * 256 + 4, 3 * 256 + 128 + 0])
    n = np.array([3.0, 3, 9, 2, 5, 7])
    got = lm._classes_of(codes, n, 4, m, 5)
    f = lambda x: x * math.log(x)
    cols, rows = m.sum(axis=0), m.sum(axis=1)

    def gain(c, left, right):
        out = sum(f(m[k, c] + x) - f(m[k, c]) for k, x in left) + sum(f(m[c, k] + x) - f(m[c, k]) for k, x in right)
        a, b = sum(x for _, x in left), sum(x for _, x in right)
        return out - (f(cols[c] + a) - f(cols[c])) - (f(rows[c] + b) - f(rows[c]))

    for w, left, right in ((0, [(2, 3)], [(3, 3)]), (3, [(1, 2), (4, 5)], [(0, 7)])):
        assert got[w] == max(range(5), key=lambda c: gain(c, left, right))
    assert got[1] == got[2] == np.argmax(cols[:5])  # no neighbour in the core


def test_contexts_skip_unknown_words():
    u, s = lm.UNKNOWN, lm.SINGLE
    cls = np.array([3, u, u | 0, 4 | s, 0, u, 2, 0], np.uint8)
    context, _ = lm._steps(cls, np.array([0, 5]), 0)
    assert context.tolist() == [0, 3, 3, 3, 4, 0, 0, 2]


def test_repeated_table(spark, frame):
    twice = lm.score(frame.union(frame), held, core=12, common=14, classes=5).collect()
    _, total, counts = plain(texts())
    assert len(twice) == 2 * len(texts()) and {r["train_tokens"] for r in twice} == {2 * total}
    assert len({(r["doc_id"], r["score"]) for r in twice}) <= len(texts())


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm.score(empty, held).count() == 0
    out = spark.createDataFrame([(1, "Some words here"), (2, None)], "doc_id long, text string")
    got = [tuple(r) for r in lm.score(out, lambda c: F.lit(True)).orderBy("doc_id").collect()]
    assert got == [(1, True, 4, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    one = spark.createDataFrame([(None, None, 5), (2, "", 6)], "doc_id long, text string, classes int")
    for r in lm.score(one, held).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (1, 1, 2)
        assert math.isclose(r["base_score"], math.log10(3 / 4)) and r["score"] <= 0

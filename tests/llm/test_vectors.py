"""Hard negatives and whitening on small tables, against plain numpy, and their edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v int, rank double"


def table(seed: int = 0, n: int = 230, dim: int = 7) -> list[tuple]:
    """Vectors with ties, repeated rows, shared and null ids, nulls and non-finite entries."""
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 1), 1) for _ in range(dim)], rng.choice([1, 1, 1, 2, 3])) for i in range(n)]
    rows += rng.choices(rows, k=25)
    rows += [(n, [0.5] * dim, 1), (n, [0.25] * dim, 1), (n + 1, None, 1), (n + 2, [1.0] * dim, None), (n + 3, [math.nan] + [1.0] * (dim - 1), 1),
             (n + 4, [None] + [1.0] * (dim - 1), 2), (n + 5, [math.inf] + [1.0] * (dim - 1), 2), (n + 6, [], 3), (n + 7, [1.0, 2.0], 3), (n + 8, [3.0, 2.0], 1),
             (None, [1.5] * dim, 1), (None, [1.5] * dim, 2), (0, [0.0] * dim, 2)]
    return [(*r, "x", 1, 0.5) for r in rows]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 11 hard negatives -----------------------------------------------------------

@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 9), (33, 65, 40), (70, 64, 130), (0, 3, 4)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    n, m, k = shape
    a, b = rng.integers(-300, 300, (n, m)), rng.integers(-300, 300, (m, k))
    assert (hard_negatives.strassen(a, b, 4) == a @ b).all()
    big = a * (1 << 45)  # leaves beyond double precision, results within 64 bits
    assert (hard_negatives.strassen(big, b % 8, 4) == big @ (b % 8)).all()


def test_scores_beyond_64_bits_are_held():
    a = np.array([[1 << 62, 1 << 62], [3, -4]])
    assert hard_negatives.scores(a, a).tolist() == [[hard_negatives.MOST, -(1 << 62)], [-(1 << 62), 25]]


def mined(rows: list[tuple], every: int, positives: int = 5, negatives: int = 10) -> set[tuple]:
    """Plain version over distinct rows."""
    good = {(i, label, tuple(e)) for i, e, label, *_ in rows
            if label is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)}
    whole = [(i, label, [math.floor(256 * float(np.float32(c))) for c in e], e) for i, label, e in good]
    last = lambda i: math.inf if i is None else i
    out = set()
    for a in whole:
        if a[0] is None or a[0] % every:
            continue
        seen = [(sum(x * y for x, y in zip(a[2], c[2])), c) for c in whole if c is not a and len(c[2]) == len(a[2])]
        seen.sort(key=lambda t: (-t[0], last(t[1][0])))
        for p, c in [t for t in seen if t[1][1] == a[1]][:positives]:
            fit = [t for t in seen if t[1][1] != a[1] and 30 * p <= 100 * t[0] <= 90 * p][:negatives]
            out |= {(a[0], c[0], k, t[1][0], p, t[0]) for k, t in enumerate(fit, 1)}
    return out


def unique_ids(rows: list[tuple]) -> list[tuple]:
    """Rows that share their id only with equal rows, as order among the others is by hash."""
    return [r for r in rows if r[0] is None or [q[1] for q in rows if q[0] == r[0]].count(r[1]) == [q[0] for q in rows].count(r[0])]


@pytest.mark.parametrize("pass_bytes", [1 << 24, 300])
def test_hard_negatives(spark, pass_bytes):
    rows = unique_ids(table())
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, pass_bytes=pass_bytes).collect()]
    want = mined(rows, 10)
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
    twice = hard_negatives.mine(df.union(df), F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in twice.collect()} == want


def test_hard_negatives_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_TILE", 3)
    rows = unique_ids(table(4))
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = hard_negatives.mine(df, F.col("vec_id") % 3 == 0, positives=2, negatives=3)
    assert {tuple(r) for r in got.collect()} == mined(rows, 3, 2, 3)


def test_heaps_fold_tiles_of_any_size():
    rng = np.random.default_rng(3)
    ids, tags = np.arange(400), rng.integers(0, 9, 400)
    s = rng.integers(-5, 5, (6, 400))
    ok = rng.random((6, 400)) < 0.6
    for step in (1, 37, 400):
        h = hard_negatives.Heaps(8, 10)
        for b in rng.permutation(range(0, 400, step)):
            at = slice(b, b + step)
            for _ in range(2):  # a tile seen twice changes nothing
                h.push(np.arange(6) + 1, s[:, at], ok[:, at], ids[at], tags[at])
        for r in range(6):
            want = sorted((-s[r, j], j) for j in range(400) if ok[r, j])[:10]
            assert list(zip(-h.score[r + 1][: h.size[r + 1]], h.id[r + 1])) == want


def test_hard_negatives_edges(spark, frame, empty):
    assert hard_negatives.mine(empty, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame, F.lit(False)).count() == 0
    assert hard_negatives.mine(frame, F.col("vec_id") % 10 == 0).count() > 100
    one = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (None, [0.5], 2)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in hard_negatives.mine(one, F.col("vec_id") == 0).collect()] == [(0, 1, 1, None, 65536, 32768)]


# -- 13 whitening ------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["plain", "two values", "decades", "zero", "identity", "blocks"])
def test_eigen(kind):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    e = {"plain": rng.random(24), "two values": np.r_[np.ones(9), 2 * np.ones(15)], "decades": np.logspace(0, -16, 24), "zero": np.zeros(24),
         "identity": np.full(24, 3.0), "blocks": np.r_[np.zeros(12), np.linspace(1, 2, 12)]}[kind]
    a = q @ np.diag(e) @ q.T
    got, v = whitening.eigen(a)
    assert np.abs(got - np.sort(e)[::-1]).max() < 1e-14 * 24
    assert np.abs(v.T @ v - np.eye(24)).max() < 1e-13 and np.abs(a @ v - v * got).max() < 1e-13


def test_polar_factor():
    a = np.random.default_rng(2).standard_normal((30, 30))
    a = a + a.T
    w, u = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - u @ np.diag(np.sign(w)) @ u.T).max() < 1e-12


def test_whitening(frame):
    rows = [r for r in table() if r[1] is not None and len(r[1]) == 7 and all(c is not None and math.isfinite(c) for c in r[1])]
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    assert n < len(rows)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    got = whitening.whiten(frame).toPandas()
    assert len(got) == 7 * len(rows) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    assert sorted(got[got.component == 1].deviation) == sorted(((n * x - s) ** 2).sum(axis=1))
    for k in range(7):
        mine = got[got.component == k + 1]
        assert np.allclose(mine.explained, e[k] / e.sum(), rtol=1e-12)
        want, have = np.sort((x - s / n) @ v[:, k] / np.sqrt(e[k])), np.sort(mine.whitened)
        assert min(np.abs(want - have).max(), np.abs(np.sort(-want) - have).max()) < 1e-8


def test_whitening_edges(spark, empty):
    assert whitening.whiten(empty).columns == whitening.RESULT.names and whitening.whiten(empty).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(df).count() == 0  # one vector: no variance
    df = spark.createDataFrame([(1, [1.0, 2.0, 9.0]), (None, [3.0, 2.0, 9.0]), (2, [1e300, 0.0, 0.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9), r["explained"]) for r in whitening.whiten(df).collect()), key=str)
    assert got == [(1, 1, 2, 128**2, 1.0, 1.0), (None, 1, 2, 128**2, 1.0, 1.0)]


def test_deviation_beyond_64_bits():
    x = np.array([[1 << 40, 0], [0, 1]])
    assert whitening.deviations(x, 1 << 30, [0, 0]).tolist() == [(1 << 63) - 1, 1 << 60]

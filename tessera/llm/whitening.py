"""Embedding whitening (operator 13): QDWH spectral divide-and-conquer.

Each entry c becomes the integer x = floor(64 c) + 1000000. The fit list holds
each distinct x vector once (folded by a 128-bit key, one shuffle of the
vectors). Tasks add up its sums, then its products, centred by the exact mean
before they are multiplied; a table of d by d doubles is all that reaches the
driver. There the covariance is split by spectral divide-and-conquer: the
polar factor U of the shifted matrix A - s I, found by the QR-based dynamically
weighted Halley iteration (QDWH), gives the projector (U + I) / 2 onto the
eigenvectors above the shift; the invariant subspaces on both sides are split
again until one direction is left. The mean and the scaled components (d by
``components`` doubles) are broadcast, and every row is whitened where it lies.

Edge cases: rows whose vector is null, or holds a null, a non-finite entry or
one of 2**40 or more in size, drop out, and so do vectors of another length than
the most frequent one (the longer one of equals). Repeated rows, also with
repeated or null ids, are one entry of the fit list and rows of their own in the
result. A component whose variance is not above ``RANK`` times the largest has
no scale and is left out, so a fit list of one vector gives no rows. In a tie of
eigenvalues any orthonormal basis of their space is taken. ``deviation`` is held at
2**63 - 1. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import hash_id, saved
from tessera.session import ship_library

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LIMIT = float(1 << 40)
RANK = 1e-10
EPS = float(np.finfo(np.float64).eps)
MOST = (1 << 63) - 1

RESULT = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
    T.StructField("identity_error", T.DoubleType())])


# -- spectral divide-and-conquer ----------------------------------------------

def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH."""
    n = len(a)
    eye = np.eye(n)
    norm = np.linalg.norm(a)
    if norm == 0:
        return eye
    x = a / norm
    # lower bound of the smallest singular value, from the triangular factor
    r = np.abs(np.diag(np.linalg.qr(x, mode="r")))
    low = max(r.min() / n, EPS / n)
    for _ in range(30):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2)) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - l2) / (l2 * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            z = np.linalg.cholesky(eye + wc * (x.T @ x))
            half = np.linalg.solve(z, x.T)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(z.T, half).T
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        if moved <= np.cbrt(4 * EPS) and abs(low - 1) <= 8 * EPS:
            break
    return x


def _subspaces(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """An orthonormal basis whose first k columns span the eigenvectors above the shift, k, and what couples both parts."""
    n = len(a)
    p = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(p)))
    if not 0 < k < n:
        return np.eye(n), 0, np.inf
    basis = rng.standard_normal((n, n))
    for _ in range(2):
        up = np.linalg.qr(p @ basis[:, :k])[0]
        down = basis[:, k:] - p @ basis[:, k:]
        basis = np.linalg.qr(np.hstack([up, down - up @ (up.T @ down)]))[0]
    return basis, k, float(np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]))


def _split(a: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    diag = np.diag(a).copy()
    if n == 1 or np.linalg.norm(a - np.diag(diag)) <= EPS * scale:
        return diag, np.eye(n)
    best = None
    near = np.sort(diag)
    middle = n // 2
    shifts = [(near[middle - 1] + near[middle]) / 2, diag.mean(), float(np.median(diag)), (near[0] + near[-1]) / 2]
    for shift in shifts:
        basis, k, rest = _subspaces(a, shift, rng)
        if k and (best is None or rest < best[2]):
            best = basis, k, rest
        if best and best[2] <= 10 * n * EPS * scale:
            break
    if best is None:  # all eigenvalues are equal to working precision
        return diag, np.eye(n)
    basis, k, _ = best
    out_e, out_v = [], []
    for part in (basis[:, :k], basis[:, k:]):
        inner = part.T @ a @ part
        e, v = _split((inner + inner.T) / 2, scale, rng)
        out_e.append(e)
        out_v.append(part @ v)
    return np.concatenate(out_e), np.hstack(out_v)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a = (a + a.T) / 2
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    _, v = _split(a, max(float(np.linalg.norm(a)), np.finfo(np.float64).tiny), np.random.default_rng(13))
    for _ in range(2):  # first-order correction of what rounding in the splits left off the diagonal
        t = v.T @ a @ v
        e = np.diag(t)
        gap = e[None, :] - e[:, None]
        turn = np.where(np.abs(t) < 0.01 * np.abs(gap), t / np.where(gap == 0, 1, gap), 0.0)
        np.fill_diagonal(turn, 0.0)
        v = np.linalg.qr(v + v @ turn)[0]
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


# -- sums over the fit list ---------------------------------------------------

def _integers(column: pa.Array, dim: int) -> np.ndarray:
    """x of each vector: floor(64 c) + 1000000."""
    flat = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _summed(df: DataFrame, fn, size: int, kind: T.DataType) -> list:
    """Sums over all batches of ``fn(batch)``, an array of ``size`` numbers; each task adds up its own."""
    ship_library(df.sparkSession)
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("part", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for batch in batches:
            if batch.num_rows:
                got = fn(batch)
                total = got if total is None else total + got
                rows += batch.num_rows
            if rows > 1 << 16 and isinstance(kind, T.LongType):  # integers are added on in decimals
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], schema=arrow)
                total, rows = None, 0
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], schema=arrow)

    part = F.col("part").cast("decimal(38,0)") if isinstance(kind, T.LongType) else F.col("part")
    got = df.mapInArrow(run, schema).groupBy("at").agg(F.sum(part).alias("s")).collect()
    out: list = [0] * size
    for at, s in got:
        out[at] = int(s) if isinstance(kind, T.LongType) else s
    return out


def fit(vectors: DataFrame, dim: int, components: int) -> dict | None:
    """Mean, whitening matrix, explained shares and identity error over the fit list (column ``v``)."""
    n, *sums = _summed(vectors, lambda b: np.append(b.num_rows, _integers(b.column("v"), dim).sum(axis=0)), dim + 1, T.LongType())
    if not n:
        return None
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.float64) / n
    upper = np.triu_indices(dim)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        y = (_integers(batch.column("v"), dim) - whole).astype(np.float64) - rest
        return (y.T @ y)[upper]

    cov = np.zeros((dim, dim))
    cov[upper] = np.array(_summed(vectors, products, len(upper[0]), T.DoubleType())) / n
    cov = np.triu(cov) + np.triu(cov, 1).T
    e, v = eigen(cov)
    k = min(components, int((e > RANK * max(e[0], 0.0)).sum())) if dim else 0
    matrix = v[:, :k] / np.sqrt(e[:k])

    def check(batch: pa.RecordBatch) -> np.ndarray:
        w = ((_integers(batch.column("v"), dim) - whole).astype(np.float64) - rest) @ matrix
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    error = 0.0
    if k:
        seen = np.array(_summed(vectors, check, k + k * k, T.DoubleType())) / n
        error = float(np.abs(seen[k:].reshape(k, k) - np.outer(seen[:k], seen[:k]) - np.eye(k)).max())
    return {"n": n, "sums": sums, "whole": whole, "rest": rest, "matrix": matrix, "explained": e[:k] / np.trace(cov) if k else e[:0], "error": error}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over the dimensions of (n x - S)**2, exact; held at 2**63 - 1."""
    d = x.shape[1]
    most = max([n * int(x.max(initial=0)), *map(abs, sums), n * -int(x.min(initial=0))], default=0)
    if most < 1 << 62:
        z = n * x - np.array(sums, np.int64)
        if d * int(np.abs(z).max(initial=0)) ** 2 <= MOST:
            return (z * z).sum(axis=1)
    exact = n * x.astype(object) - np.array(sums, object)
    return np.array([min(MOST, sum(int(v) * int(v) for v in row)) for row in exact], np.int64)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LIMIT))
    rows = rows.where(F.col("v").isNotNull() & fits)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    dim = common["dim"]
    rows = rows.where(F.size("v") == dim)
    key = hash_id(F.transform("v", lambda c: F.floor(c.cast("double") * SCALE)))
    distinct = saved(rows.groupBy(key.alias("key")).agg(F.first("v").alias("v")).select("v"), "fit-list")
    model = fit(distinct, dim, components)
    if model is None or not len(model["explained"]):
        return spark.createDataFrame([], RESULT)
    shared = spark.sparkContext.broadcast(model)
    arrow = to_arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m["explained"])
        for batch in batches:
            rows_in = batch.num_rows
            if not rows_in:
                continue
            x = _integers(batch.column("v"), dim)
            w = ((x - m["whole"]).astype(np.float64) - m["rest"]) @ m["matrix"]
            at = pa.array(np.repeat(np.arange(rows_in), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_in)),
                pa.array(np.full(rows_in * k, m["n"], np.int64)), pa.array(np.repeat(deviations(x, m["n"], m["sums"]), k)), pa.array(w.ravel()),
                pa.array(np.tile(m["explained"], rows_in)), pa.array(np.full(rows_in * k, m["error"]))], schema=arrow)

    return rows.mapInArrow(run, RESULT)

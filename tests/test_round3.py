"""Exact vector search with pruning, grain search, stored profiles and smoothing,
against plain Python."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quality as Q, ranking
from tessera.operators.retrieval import similar_top_k
from tessera.operators.vector_index import VectorIndex
from tessera.sources.stage import new_folder


# -- H-7 -------------------------------------------------------------------------

def clustered(seed=0, n=3000, dim=8, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim)) * 10
    x = c[rng.integers(0, centres, n)] + rng.standard_normal((n, dim)) * 0.3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows[5] = (5, rows[4][1])  # a tie
    return rows + [(n, None), (n + 1, [0.0] * dim), (n + 2, [1.0, 2.0]), (n + 3, [None] + [1.0] * (dim - 1))], c


@pytest.mark.parametrize("per_pass", [2048, 3])
def test_index_equals_the_full_scan_and_skips(spark, per_pass):
    rows, centres = clustered()
    lib = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    qs = [(i, [float(v) for v in c]) for i, c in enumerate(centres)] + [(50, rows[4][1]), (60, [0.0] * 8), (61, None)]
    queries = spark.createDataFrame(qs, "query_id int, embedding array<double>")
    got, skipped = VectorIndex(lib, pivots=40).search(queries, 7, per_pass=per_pass)
    want = {tuple(r) for r in similar_top_k(queries, lib, 7).collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 7 * len(qs)
    assert skipped > 0.4
    assert got.schema["query_id"].dataType.simpleString() == "int"


def test_index_of_few_and_of_no_vectors(spark):
    one = spark.createDataFrame([(3, [1.0, 0.0]), (1, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, embedding array<double>")
    assert [tuple(r) for r in VectorIndex(one).search(q, 5)[0].orderBy("rank").collect()] == [(1, 1, 3, 1.0), (1, 2, 1, None)]
    none = one.where("vec_id > 9")
    rows, skipped = VectorIndex(none).search(q, 5)
    assert rows.count() == 0 and skipped == 0


# -- E-3 -------------------------------------------------------------------------

def test_find_grain_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i // 10, i % 10, rng.choice([None, "a", "b"]), i // 3, i % 3, 7) for i in range(600)]
    cols = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(rows, "a int, b int, c string, d int, e int, f int")
    keys = []
    for w in (1, 2, 3):
        for c in itertools.combinations(range(6), w):
            if not any(set(k) <= set(c) for k in keys) and len({tuple(r[i] for i in c) for r in rows}) == len(rows):
                keys.append(c)
    got = Q.find_grain(df, per_pass=4).collect()
    assert sorted(r["key_columns"] for r in got) == sorted(",".join(cols[i] for i in c) for c in keys) and len(keys) >= 2
    assert all(r["n_confirmed"] < r["n_sketched"] for r in got)  # the sketches rule most sets out
    assert Q.find_grain(df.union(df)).count() == 0


def test_find_grain_counts_nulls_as_values(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None), (1, 1)], "a int, b int")
    assert [r["key_columns"] for r in Q.find_grain(df).collect()] == ["a,b"]
    assert Q.find_grain(spark.createDataFrame([(None,), (None,)], "a int")).count() == 0


# -- E-1 -------------------------------------------------------------------------

def test_union_of_days_equals_the_whole(spark):
    rng = random.Random(6)
    day = dt.date(2024, 1, 1)
    rows = [(day + dt.timedelta(days=rng.randrange(6)), i, rng.choice([None, "", "x", "y"]), float(rng.randrange(500))) for i in range(6000)]
    df = spark.createDataFrame(rows, "day date, id long, s string, v double")
    days, whole = Q.ProfileStore(spark, new_folder(spark, "p")), Q.ProfileStore(spark, new_folder(spark, "q"))
    for k in range(6):  # a day at a time
        days.put(df.where(F.col("day") == day + dt.timedelta(days=k)), "day")
    days.put(df.where(F.col("day") == day), "day")  # again
    whole.put(df.withColumn("day", F.lit(day)), "day")
    got = {r["column_name"]: tuple(r)[1:] for r in days.profile().collect()}
    want = {r["column_name"]: tuple(r)[1:] for r in whole.profile().collect()}
    assert set(got) == {"id", "s", "v"}
    for c in got:
        assert got[c][:2] == want[c][:2] and abs(got[c][2] - want[c][2]) <= 0.02 * want[c][2]
    exact = {r["column_name"]: r["n_distinct"] for r in Q.distinct_counts(df, ["id", "s", "v"]).collect()}
    assert exact == {"id": 6000, "s": 3, "v": len({r[3] for r in rows})}
    assert all(abs(got[c][2] - exact[c]) <= 0.05 * exact[c] for c in exact)
    part = {r["column_name"]: r["n_rows"] for r in days.profile("2024-01-02", "2024-01-03").collect()}
    assert set(part.values()) == {sum(r[0] in (dt.date(2024, 1, 2), dt.date(2024, 1, 3)) for r in rows)}


def test_distinct_counts_of_an_empty_column(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert {r[0]: r[1] for r in Q.distinct_counts(df, ["a", "b"]).collect()} == {"a": 1, "b": 0}


# -- F-12 ------------------------------------------------------------------------

def holt(x, alpha, beta):
    level, trend, out = x[0], 0.0, [(x[0], 0.0)]
    for v in x[1:]:
        new = alpha * v + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend if beta is not None else 0.0
        level = new
        out.append((level, trend))
    return out


@pytest.mark.parametrize("beta", [None, 0.3])
def test_smoothing_backtest(spark, beta):
    rng = random.Random(8)
    series = {"a": [10 + 2 * i + rng.random() for i in range(40)], "b": [rng.random() for _ in range(9)], "c": [5.0]}
    rows = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, day int, value double").repartition(3)
    got = {(r["k"], r["alpha"], r["horizon"]): (r["n_origins"], r["mae"]) for r in ranking.smoothing_backtest(df, ["k"], "day", "value", 3, 5, (0.2, 0.8), beta).collect()}
    assert len(got) == 3 * 2 * 3
    for (k, alpha, h), (n, mae) in got.items():
        x, f = series[k], holt(series[k], alpha, beta)
        errors = [abs(x[o + h - 1] - (f[o - 1][0] + h * f[o - 1][1])) for o in range(5, len(x) - h + 1)]
        assert n == len(errors) and (mae is None if not errors else abs(mae - sum(errors) / n) < 1e-9)
    f = {(r["k"], r["horizon"]): r for r in ranking.smoothing_forecast(df, ["k"], "day", "value", 2, 5, (0.2, 0.8)).collect()}
    assert f["a", 1]["alpha"] == 0.8 and f["c", 2]["forecast"] == 5.0 and f["c", 1]["alpha"] == 0.2 and f["a", 2]["last"] == 39

"""Exact scalable quantiles against numpy (R type 7)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.quantiles import column_quantiles, grouped_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def exact_quantiles(df, col, probs, **kw):
    qs = column_quantiles(df, col, probs, **kw)
    return list(df.sparkSession.range(1).select(*[q.alias(f"q{i}") for i, q in enumerate(qs)]).first())


def frame(spark, xs, parts=4):
    return spark.createDataFrame([(x,) for x in xs], "x double").repartition(parts)


@pytest.mark.parametrize("half", [4e-4, 0.02])
@pytest.mark.parametrize("case", ["smooth", "hot_value", "negatives", "tiny_range", "ties"])
def test_matches_numpy(spark, case, half):
    rng = random.Random(case.__hash__() % 1000)
    if case == "smooth":
        xs = [rng.gauss(100, 30) for _ in range(20000)]
    elif case == "hot_value":
        xs = [42.0 if i % 3 == 0 else rng.random() * 1000 for i in range(20000)]  # a third identical
    elif case == "negatives":
        xs = [rng.uniform(-1e6, 1e6) for _ in range(5000)]
    elif case == "tiny_range":
        xs = [1.0 + rng.random() * 1e-9 for _ in range(5000)]
    else:
        xs = [float(rng.randint(0, 5)) for _ in range(5000)]
    got = exact_quantiles(frame(spark, xs), "x", PROBS, half=half)
    exp = np.quantile(np.array(xs), PROBS, method="linear")
    assert got == pytest.approx(list(exp), rel=1e-12, abs=1e-12)


def test_missing_and_edge_sizes(spark):
    xs = [3.0, None, float("nan"), 1.0, 2.0]
    assert exact_quantiles(frame(spark, xs), "x", [0.5]) == [2.0]
    assert exact_quantiles(frame(spark, [7.0]), "x", [0.25, 0.75]) == [7.0, 7.0]
    assert exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_grouped_quantiles_match_numpy(spark):
    rng = random.Random(12)
    rows = []
    for i in range(12000):
        g = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        x = 7.0 if (g == "hot" and i % 2 == 0) else rng.gauss(50, 20)
        rows.append((g, None if i % 97 == 0 else x))
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r["g"]: [r["_q0"], r["_q1"], r["_q2"]] for r in
           grouped_quantiles(df, "x", ["g"], [0.25, 0.5, 0.75], half=0.02).collect()}
    for g in ["hot", "a", "b", None]:
        xs = np.array([x for k, x in rows if k == g and x is not None])
        assert got[g] == pytest.approx(list(np.quantile(xs, [0.25, 0.5, 0.75], method="linear")), rel=1e-12)


def test_many_groups(spark):
    """More groups than any fixed limit, in one plan."""
    df = spark.range(60000).selectExpr("id % 20000 AS g", "double(hash(id)) AS x")
    got = {r["g"]: r["_q0"] for r in grouped_quantiles(df, "x", ["g"], [0.5]).collect()}
    exp = {}
    for r in df.collect():
        exp.setdefault(r["g"], []).append(r["x"])
    assert got == {g: float(np.median(v)) for g, v in exp.items()}


def test_no_job_runs_while_building(spark):
    """Every operator with quantiles only builds a plan."""
    from tessera.operators import ledger, quality, stats

    df = spark.range(100).selectExpr("double(id) AS x", "id % 3 AS g", "timestamp_ntz '2024-01-01' AS t")
    sc = spark.sparkContext
    sc.setJobGroup("quantile-build", "no job may run")
    try:
        stats.describe_numeric(df, "x", ["g"])
        stats.describe_numeric(df, "x")
        stats.histogram(df, "x")
        stats.boxplot_stats(df, "x")
        stats.distribution_label(df, "x")
        quality.outliers_iqr(df, "x")
        quality.cap_outliers(df, ["x"])
        quality.impute(df, ["x"], "median")
        ledger.rfm_scores(df, "g", "t", "x", "2024-02-01")
        assert not sc.statusTracker().getJobIdsForGroup("quantile-build")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_several_columns_in_one_plan(spark):
    from tessera.operators.stats import columns_quantiles, global_quantiles
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("a"), F.when(F.col("id") % 3 > 0, F.sqrt("id")).alias("b"),
                                  F.lit(None).cast("double").alias("c"))
    probs = [0.2, 0.5, 0.95]
    cuts = columns_quantiles(df, ("a", "b", "c"), probs)
    got = spark.range(1).select(*[x.alias(f"{c}{i}") for c in "abc" for i, x in enumerate(cuts[c])]).first()
    want = spark.range(1).select(*[x.alias(f"{c}{i}") for c in "abc" for i, x in enumerate(global_quantiles(df, c, probs))]).first()
    assert got == want and got["c0"] is None

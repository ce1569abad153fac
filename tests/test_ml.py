"""ML invariants (fixed seeds; never exact trees)."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tessera.operators import ml
from tessera.plans.registry import load_all


def test_f1_formula_on_published_pairs():
    # precision/recall -> F1 as published for the four churn models
    for p, r, f1 in [(64.8, 57.2, 60.8), (60.4, 61.5, 60.9), (63.7, 50.3, 56.2), (59.6, 52.4, 55.8)]:
        assert round(2 * p * r / (p + r), 1) == f1


def test_evaluate_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 1), round(rng.random(), 2)) for i in range(400)]
    rows = [(i, y, s, 1 if s >= 0.5 else 0) for i, y, s in rows]
    df = spark.createDataFrame(rows, "id int, label int, p_pos double, prediction int")
    m = ml.evaluate(df).first()
    tp = sum(1 for _, y, _, p in rows if y == 1 and p == 1)
    fp = sum(1 for _, y, _, p in rows if y == 0 and p == 1)
    fn = sum(1 for _, y, _, p in rows if y == 1 and p == 0)
    prec, rec = tp / (tp + fp), tp / (tp + fn)
    assert m["precision"] == pytest.approx(prec) and m["recall"] == pytest.approx(rec)
    assert m["f1"] == pytest.approx(2 * prec * rec / (prec + rec))
    pos = [s for _, y, s, _ in rows if y == 1]
    neg = [s for _, y, s, _ in rows if y == 0]
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    assert m["auc"] == pytest.approx(wins / (len(pos) * len(neg)))


def test_models_and_scores(spark):
    qs = load_all()
    tc = qs["train_compare"].build(spark, SF_SMALL).collect()
    assert {r["model"] for r in tc} == {"logistic_regression", "decision_tree", "random_forest", "boosted_trees"}
    for r in tc:
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] > 0 and 0 <= r["accuracy"] <= 1
    sb = qs["score_batch"].build(spark, SF_SMALL)
    assert sb.filter((F.col("p_pos") < 0) | (F.col("p_pos") > 1)).count() == 0
    assert sb.select("risk").distinct().count() <= 3
    coef = qs["coefficients"].build(spark, SF_SMALL).collect()
    assert len(coef) >= len(["n_orders", "mean_price", "recency_days", "c_acctbal", "n_events"])


def nearest(rows, caliper):
    """id -> control id for (id, treated, score) rows, over all controls."""
    out, order = {}, sorted((s, i, t) for i, t, s in rows if s is not None)
    for i, t, s in rows:
        if t == 1:
            out[i] = None
    for k, (s, i, t) in enumerate(order):
        if t == 1:
            lo = next((x for x in reversed(order[:k]) if x[2] == 0), None)
            hi = next((x for x in order[k + 1 :] if x[2] == 0), None)
            best = lo if lo and (hi is None or s - lo[0] <= hi[0] - s) else hi
            if best and (caliper is None or abs(best[0] - s) <= caliper):
                out[i] = best[1]
    return out


def test_match_on_score_brute_force(spark):
    rng = random.Random(6)
    # crowded scores, ties, missing scores, far treated rows
    rows = [(i, rng.randint(0, 1), rng.choice([None, float(rng.randint(0, 40)), 20 + rng.randint(0, 9) / 8, rng.random() * 1e4])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, treated int, s double").withColumn("y", F.col("id") * 2)
    for caliper in (None, 0.5):
        got = {r["id"]: (r["control_id"], r["y_control"]) for r in ml.match_on_score(df, "s", "treated", "y", "id", caliper, buckets=8).collect()}
        assert got == {i: (c, None if c is None else 2 * c) for i, c in nearest(rows, caliper).items()}


def test_psm_keeps_rows_with_missing_covariates(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(0, 1), None if i % 10 == 0 else rng.random() * 10, rng.random() * 5, float(rng.randint(0, 100))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, treated int, a double, b double, y double")
    got = {r["id"]: r for r in ml.match_psm(df, "treated", ["a", "b"], "y", "id", caliper=None).collect()}
    assert set(got) == {r[0] for r in rows if r[1] == 1}
    assert all((got[i]["control_id"] is None) == (i % 10 == 0) for i in got)
    rows_out, _ = ml.cluster_behaviour(df, ["a", "b"], 3)
    assert rows_out.count() == 300 and rows_out.filter("cluster IS NULL").count() == 30


def test_clusters_recommendations_matching(spark):
    qs = load_all()
    cl = qs["cluster_behaviour"].build(spark, SF_SMALL).collect()
    assert len(cl) == 4 and sum(r["n"] for r in cl) == spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    rec = qs["recommend"].build(spark, SF_SMALL)
    assert rec.groupBy("user").count().filter(F.col("count") > 5).count() == 0
    m = qs["match_psm"].build(spark, SF_SMALL).collect()
    assert all(r["control_id"] is None or r["y_control"] is not None for r in m)
    st = qs["stability"].build(spark, SF_SMALL).collect()
    assert all(r["acc_low"] <= r["acc_high"] for r in st)


def test_auc_over_many_ranges_and_missing_scores(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 1), rng.choice([None, 0.5, rng.random() ** 8, float(rng.randint(0, 3))])) for _ in range(500)]
    df = spark.createDataFrame(rows, "label int, p double").repartition(7)
    pos, neg = ([s for y, s in rows if y == v and s is not None] for v in (1, 0))
    wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    for buckets in (1, 3, 40):
        auc = df.select(ml.roc_auc(df, "label", "p", buckets).alias("auc")).first()[0]
        assert auc == pytest.approx(wins / (len(pos) * len(neg)))


def test_split_and_bootstrap_hang_on_the_key_alone(spark):
    df = spark.range(4000).select("id", (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 7 < 4).cast("int").alias("label"),
                                  (F.col("id") % 5 < 3).cast("int").alias("prediction"))
    one, many = df.coalesce(1), df.repartition(9)
    train, test = ml.split_by_key(one, "id")
    again = ml.split_by_key(many, "id")
    assert {r["id"] for r in test.collect()} == {r["id"] for r in again[1].collect()}
    assert train.count() + test.count() == 4000 and 700 < test.count() < 900
    a, b = (sorted(map(tuple, ml.stability(x, "g", "label", "prediction", "id").collect())) for x in (one, many))
    assert a == b and all(low < acc < high for _, acc, _, low, high in a)


def test_poisson_weights(spark):
    cdf = ml.poisson1_cdf()
    assert len(cdf) >= 15 and cdf == sorted(cdf) and cdf[-1] == pytest.approx(1.0, abs=1e-15)
    u = [0.0, cdf[0] - 1e-12, cdf[0], cdf[3], 1 - 1e-9]
    got = spark.createDataFrame([(x,) for x in u], "u double").select(ml.poisson1_weight(F.col("u"))).collect()
    assert [r[0] for r in got] == [sum(x >= c for c in cdf) for x in u]

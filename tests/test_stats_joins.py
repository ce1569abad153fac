"""Statistics, joins and ranking against numpy / brute force on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import joins as J, ranking as RK, stats as S, quality as Q


def r7(xs, p):
    return float(np.quantile(np.array(xs, dtype=float), p, method="linear"))


def test_describe_matches_numpy_with_missing(spark):
    vals = [1.0, 55.3, 11.7, 16.2, 3.5, None, float("nan"), 22.0, 8.8]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = S.describe_numeric(df, "x").first()
    xs = [v for v in vals if v is not None and not math.isnan(v)]
    assert r["n"] == 9 and r["n_missing"] == 2
    assert r["mean"] == pytest.approx(np.mean(xs))
    assert r["median"] == pytest.approx(r7(xs, 0.5))
    assert r["q1"] == pytest.approx(r7(xs, 0.25)) and r["q3"] == pytest.approx(r7(xs, 0.75))
    assert r["sd"] == pytest.approx(np.std(xs, ddof=1)) and r["variance"] == pytest.approx(np.var(xs, ddof=1))
    strict = S.describe_numeric(df, "x", strict_nulls=True).first()
    assert strict["mean"] is None and strict["n"] == 9


def test_describe_grouped_and_approx(spark):
    rng = random.Random(1)
    rows = [(g, rng.random() * 100) for g in "ab" for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x double")
    ex = {r["g"]: r for r in S.describe_numeric(df, "x", by=["g"]).collect()}
    ap = {r["g"]: r for r in S.describe_numeric(df, "x", by=["g"], method="approx").collect()}
    for g in "ab":
        xs = [x for k, x in rows if k == g]
        assert ex[g]["median"] == pytest.approx(r7(xs, 0.5))
        assert abs(ap[g]["median"] - ex[g]["median"]) < 2.0


def test_histogram_flat_and_empty_bins(spark):
    flat = spark.createDataFrame([(7.0,)] * 5, "x double")
    h = S.histogram(flat, "x", bins=20).orderBy("bin").collect()
    assert len(h) == 20 and h[0]["n"] == 5 and sum(r["n"] for r in h) == 5
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    h2 = S.histogram(df, "x", bins=10).orderBy("bin").collect()
    assert [r["n"] for r in h2] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 1]  # max goes to the closed last bin


def test_boxplot_and_outliers(spark):
    xs = [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id int, x double")
    b = S.boxplot_stats(df, "x").first()
    q1, q3 = r7(xs, 0.25), r7(xs, 0.75)
    assert b["upper_fence"] == pytest.approx(q3 + 1.5 * (q3 - q1))
    assert b["whisker_high"] == 9.0 and b["n_out_high"] == 1
    out = Q.outliers_iqr(df, "x", tiebreak=["id"]).collect()
    assert [r["x"] for r in out] == [100.0]


def test_top_k_ties_exactly_k(spark):
    df = spark.createDataFrame([(i, 5.0 if i < 7 else float(i)) for i in range(12)], "id int, v double")
    got = RK.top_k(df, "v", 6, tiebreak=["id"]).collect()
    assert [r["id"] for r in got] == [11, 10, 9, 8, 7, 0]
    # ties at the k-th place: five rows equal at the cut
    df2 = spark.createDataFrame([(i, 1.0) for i in range(5)] + [(9, 2.0)], "id int, v double")
    assert RK.top_k(df2, "v", 3, tiebreak=["id"]).count() == 3


@pytest.mark.parametrize("ties", [False, True])
def test_top_k_per_group_matches_brute_force(spark, ties):
    rng = random.Random(7)
    rows = [(rng.choice("abc") if i % 3 else "hot", i, float(rng.randint(0, 20))) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id int, v double")
    got = {(r["g"], r["id"]) for r in RK.top_k_per_group(df, ["g"], "v", 4, tiebreak=[] if ties else ["id"],
                                                       ties=ties, salt_buckets=8).collect()}
    exp = set()
    for g in {r[0] for r in rows}:
        grp = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))
        if ties:
            cut = grp[3][2]
            exp |= {(g, r[1]) for r in grp if r[2] >= cut}
        else:
            exp |= {(g, r[1]) for r in grp[:4]}
    assert got == exp


def test_join_coverage_brute_force(spark):
    left = spark.createDataFrame([("A",), ("B",), ("C",), (None,), ("A",)], "k string")
    right = spark.createDataFrame([("A", 1), ("A", 2), ("D", 3), (None, 4)], "k string, v int")
    r = J.join_coverage(left, right, "k", "k").first()
    # left join rows: A x2 left * 2 right = 4, B 1, C 1, null 1 -> 7
    assert (r["result_rows"], r["left_unmatched"], r["right_unmatched"], r["matched_keys"]) == (7, 3, 2, 1)
    assert J.attach_indicator(left, right, "k", "k").count() == 7


def test_related_rows_no_fan_out(spark):
    parent = spark.createDataFrame([(1, "p1"), (2, "p2")], "id int, name string")
    a = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z")], "pid int, a string")
    b = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "pid int, b int")
    r = J.related_rows(parent, {"a": a, "b": b}, "id", {"a": "pid", "b": "pid"})
    assert r.count() == 6  # 3 + 3, never 3 x 2
    counts = {(x["id"], x["relation"]): x["n_related"] for x in r.collect()}
    assert counts[(1, "a")] == 3 and counts[(1, "b")] == 2 and counts[(2, "b")] == 1


def test_latest_per_key_and_dedupe(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 3, "c"), (2, 3, "d")], "k int, t int, v string")
    latest = {r["k"]: r["v"] for r in RK.latest_per_key(df, ["k"], "t", tiebreak="v").collect()}
    assert latest == {1: "b", 2: "d"}
    first = {r["k"]: r["v"] for r in Q.dedupe(df, ["k"], ["t", "v"], keep="first").collect()}
    assert first == {1: "a", 2: "c"}


def test_stock_history_matches_running_sum(spark):
    from tessera.operators.ledger import stock_history
    rng = random.Random(3)
    rows = []
    for i in range(400):
        item = "hot" if i % 2 else rng.choice("xyz")
        day = rng.randint(1, 27)
        rows.append((item, f"2024-{rng.randint(1, 6):02d}-{day:02d} 00:00:00", i, float(rng.randint(-5, 5))))
    df = spark.createDataFrame(rows, "item string, ts string, move_id int, qty double") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["move_id"]: r["balance"] for r in stock_history(df).collect()}
    for item in {r[0] for r in rows}:
        bal = 0.0
        for r in sorted([r for r in rows if r[0] == item], key=lambda r: (r[1], r[2])):
            bal += r[3]
            assert got[r[2]] == pytest.approx(bal)


def test_kpi_overall_is_mean_of_indices():
    # published roll-up: mean(78.5, 82.3, 88.7) rounds to 83.2
    assert round((78.5 + 82.3 + 88.7) / 3, 1) == 83.2


def test_similar_top_k_brute_force(spark):
    from tessera.operators.retrieval import similar_top_k
    rng = np.random.default_rng(0)
    lib = rng.normal(size=(300, 8))
    qs = rng.normal(size=(3, 8))
    ldf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(lib)],
                                "vec_id long, embedding array<double>").repartition(4)
    qdf = spark.createDataFrame([(100 + i, [float(x) for x in v]) for i, v in enumerate(qs)],
                                "query_id long, embedding array<double>")
    odd = spark.createDataFrame([(900, None), (901, [0.0] * 8), (902, [1.0])], ldf.schema)
    for block in (256, 1):  # one block, and one query a block
        got = similar_top_k(qdf, ldf.unionByName(odd), 5, block=block).collect()
        for qi, q in enumerate(qs):
            sims = lib @ q / (np.linalg.norm(lib, axis=1) * np.linalg.norm(q))
            exp = list(np.argsort(-sims, kind="stable")[:5])
            mine = [r["vec_id"] for r in sorted([r for r in got if r["query_id"] == 100 + qi], key=lambda r: r["rank"])]
            assert mine == exp
    every = similar_top_k(qdf, ldf.limit(3).unionByName(odd), 10).filter("query_id = 100").orderBy("rank").collect()
    assert [r["vec_id"] for r in every[3:]] == [900, 901, 902] and {r["score"] for r in every[3:]} == {None}


def test_similar_top_k_many_queries(spark):
    """More queries than any batch limit, none fetched while the plan is built."""
    from tessera.operators.retrieval import similar_top_k
    rng = np.random.default_rng(1)
    lib, qs = rng.normal(size=(50, 4)), rng.normal(size=(3000, 4))
    ldf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(lib)], "vec_id long, embedding array<double>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "query_id long, embedding array<double>")
    got = {r["query_id"]: r["vec_id"] for r in similar_top_k(qdf, ldf, 1).collect()}
    unit = lib / np.linalg.norm(lib, axis=1)[:, None]
    assert got == dict(enumerate((qs @ unit.T).argmax(axis=1).tolist()))

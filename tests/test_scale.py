"""Plans that keep a task's memory from growing with the input, and their results by hand."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.operators import ml, stats
from tessera.operators.cooccurrence import _count_cells
from tessera.operators.quantiles import grouped_quantiles
from tessera.streaming.stateful import FirstUse


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_quantiles_send_brackets_to_the_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), rng.gauss(0, 9)])) for _ in range(9000)] + [("few", 1.0), ("few", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = grouped_quantiles(df, "x", ["g"], [0.0, 0.3, 1.0], half=0.02)
        assert "SortMergeJoin" not in plan_of(q) and "BroadcastHashJoin" in plan_of(q)
        got = {r["g"]: list(r)[1:] for r in q.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(got) == {"a", "b", None, "few"}
    for g, values in got.items():
        xs = [x for k, x in rows if k == g and x is not None and x == x]
        assert values == pytest.approx(list(np.quantile(xs, [0.0, 0.3, 1.0])), rel=1e-12)


def test_exact_distinct_does_not_copy_the_rows(spark):
    rows = [(i, float("nan") if i % 5 == 0 else float(i % 3), f"s{i % 7}" if i % 4 else None) for i in range(100)]
    out = stats.summary_overview(spark.createDataFrame(rows, "a long, b double, c string"), exact_distinct=True)
    assert "Expand" not in plan_of(out)
    got = {r["column_name"]: (r["n_rows"], r["n_missing"], r["n_distinct"], r["min_value"]) for r in out.collect()}
    assert got == {"a": (100, 0, 100, "0"), "b": (100, 20, 4, "0.0"), "c": (100, 25, 7, "s0")}


def test_popular_items_list_only_free_ranks(spark):
    rng = random.Random(8)
    buys = [(rng.choice([None, *range(12)]), rng.choice([None, *range(15)]), float(rng.randrange(9))) for _ in range(150)] + [(3, i, 1.0) for i in range(15)]
    users = [(u, "xyz"[u % 3]) for u in range(14)] + [(3, "x"), (4, "z"), (5, "z"), (None, "y"), (6, None)]
    out = ml.recommend_popular(spark.createDataFrame(buys, "u long, i long, w double"), spark.createDataFrame(users, "u long, g string"), "u", "i", "w", "g", 3)
    assert "LeftAnti" not in plan_of(out)
    score: dict = {}
    for u, g in users:
        for v, i, w in buys:
            if u is not None and u == v and g is not None:
                score[g, i] = score.get((g, i), 0.0) + w
    want = []
    for u in {u for u, _ in users}:
        cand = []
        for g in [g for v, g in users if v == u and g is not None]:
            items = sorted((i for h, i in score if h == g), key=lambda i: (-score[g, i], i is not None, i or 0))
            cand += [(r, i is not None, i or 0, i, score[g, i]) for r, i in enumerate(items) if (u, i) not in {(a, b) for a, b, _ in buys if a is not None and b is not None}]
        want += [(u, r, c[3]) for r, c in enumerate(sorted(cand)[:3], 1)]
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    assert sorted(((r["u"], r["rank"], r["i"]) for r in out.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("k,tile_rows", [(3, 7), (5, 8192)])
def test_best_products_over_all_pairs(spark, k, tile_rows):
    rng = np.random.default_rng(5)
    u, v = (rng.integers(-3, 4, (n, 4)).astype(np.float32) for n in (40, 60))
    u[0] = 0  # every item ties
    frame = lambda x: spark.createDataFrame([(j, [float(c) for c in r]) for j, r in enumerate(x)], "id int, features array<float>").repartition(3)
    got = {(r["u"], r["rank"]): (r["i"], r["score"]) for r in ml.best_products(frame(u), frame(v), k, tile_rows).collect()}
    want = {(a, r): (b, float(s)) for a in range(40) for r, (s, b) in enumerate(sorted(((u[a] @ v[b], b) for b in range(60)), key=lambda t: (-t[0], t[1]))[:k], 1)}
    assert got == want
    few = ml.best_products(frame(u), frame(v[:2]), k, tile_rows)
    assert few.count() == 80


@pytest.mark.parametrize("part_rows", [9, 200_000])
def test_best_products_without_exceeded_items(spark, part_rows):
    rng = np.random.default_rng(7)
    # many zeros and ties, also users without any part and items that only few reach
    u, v = (rng.integers(0, 4, (n, 4)).astype(np.float32) * (rng.random((n, 4)) < 0.5) for n in (50, 300))
    u[0], u[1], v[:, 3] = 0, (0, 0, 0, 2), 0
    v[[7, 290], 3] = 1
    frame = lambda x: spark.createDataFrame([(j, [float(c) for c in r]) for j, r in enumerate(x)], "id int, features array<float>").repartition(3)
    got = {(r["u"], r["rank"]): (r["i"], r["score"]) for r in ml.best_products(frame(u), frame(v), 3, 16, part_rows).collect()}
    assert got == {(a, r): (b, float(s)) for a in range(50) for r, (s, b) in enumerate(sorted(((u[a] @ v[b], b) for b in range(300)), key=lambda t: (-t[0], t[1]))[:3], 1)}


@pytest.mark.parametrize("most,held", [(8192, 262_144), (40, 300)])
def test_exceeded_items_are_left_out(most, held):
    rng = np.random.default_rng(1)
    v = rng.exponential(1, (2000, 3)).astype(np.float32)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + 250, dtype=np.int32)), pa.array(list(v[at:at + 250]), pa.list_(pa.float32()))], names=["id", "features"])
               for at in range(0, 2000, 250)]
    kept = {i for b in ml._not_exceeded(iter(batches), 2, [3, 1999], 32, most, held) for i in b.column("id").to_pylist()}
    over = [(v >= x * np.float32(1.0001)).all(axis=1).sum() for x in v]
    assert kept >= {i for i, n in enumerate(over) if n < 2} | {3, 1999} and len(kept) < 1000


def test_blocks_of_the_fit_grow_with_the_ratings(spark, monkeypatch):
    seen = []
    als = ml.ALS
    monkeypatch.setattr(ml, "ALS", lambda **kw: seen.append((kw["numUserBlocks"], kw["numItemBlocks"])) or als(**kw))
    df = spark.createDataFrame([(u, (u * 7 + j) % 20, 1.0) for u in range(30) for j in range(4)], "u int, i int, r float")
    for some, blocks in ((4_000_000, 10), (9, 14)):
        assert ml.recommend(df, "u", "i", "r", 2, rank=2, max_iter=2, block_ratings=some).groupBy("u").count().filter("count = 2").count() == 30
        assert seen.pop() == (blocks, blocks)


@pytest.mark.parametrize("flush", [1, 50, 10_000])
def test_cells_are_counted_over_arrow_batches(flush):
    rng = random.Random(2)
    n = {i: 2 + i % 3 for i in range(30)}
    rows = [(c == 2, c, a := rng.sample(range(30), rng.randrange(1, 4)), [n[x] for x in a], m := rng.sample(range(30), rng.randrange(1, 12)), [n[x] for x in m])
            for c in range(3) for _ in range(40)]
    types = [pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at:at + 25]), types)], names=["split", "cell", "a", "na", "i", "n"]) for at in range(0, 120, 25)]
    out = [r for b in _count_cells(batches, 100, 2, flush) for r in b.to_pylist()]
    got, want = Counter(), Counter()
    for r in out:
        assert r["na"] == n[r["a"]] and r["n"] == n[r["i"]]
        got[r["split"], r["a"], r["i"]] += r["shared"]
    for c in range(3):
        met = Counter((s, x, y) for s, d, a, _, m, _ in rows if d == c for x in a for y in m if x != y)
        want.update({key: v for key, v in met.items() if key[0] or v >= 2})
    assert got == want


def test_evidence_without_an_order_leaves_no_state():
    use = FirstUse(["evidence_id"])  # never initialised: any touch of its state fails
    out = pd.concat(use.handleInputRows(("e7",), iter([pd.DataFrame({"evidence_id": [4, 5]}), pd.DataFrame({"evidence_id": [6]})]), None))
    assert out["evidence_id"].tolist() == [4, 5, 6] and not out["first_use"].any()

"""Bucketed per-key windows equal the plain windows they replace."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import windows as WB


def data(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        k = 0 if i % 3 == 0 else rng.randint(1, 12)
        v = None if rng.random() < 0.2 else float(rng.randint(-50, 50))
        rows.append((k, i, rng.randint(0, 10_000), v))
    return spark.createDataFrame(rows, "k int, id int, t int, v double")


def as_map(df, col):
    return {r["id"]: r[col] for r in df.select("id", col).collect()}


def test_running_sum_max(spark):
    df = data(spark)
    bucket = F.floor(F.col("t") / 500)
    order = ["t", "id"]
    w = Window.partitionBy("k").orderBy(*order)
    for fn, agg in (("sum", F.sum), ("max", F.max), ("min", F.min)):
        for excl in (False, True):
            frame = w.rowsBetween(Window.unboundedPreceding, -1 if excl else 0)
            exp = as_map(df.withColumn("e", agg("v").over(frame)), "e")
            got = as_map(WB.running(df, ["k"], order, "v", bucket, "g", fn, exclusive=excl), "g")
            assert got == exp, (fn, excl)


def test_shift(spark):
    df = data(spark)
    bucket = F.floor(F.col("t") / 700)
    w = Window.partitionBy("k").orderBy("t", "id")
    assert as_map(WB.shift(df, ["k"], ["t", "id"], "v", bucket, "g", "lag"), "g") == \
        as_map(df.withColumn("e", F.lag("v").over(w)), "e")
    assert as_map(WB.shift(df, ["k"], ["t", "id"], "v", bucket, "g", "lead"), "g") == \
        as_map(df.withColumn("e", F.lead("v").over(w)), "e")


def test_last_non_null(spark):
    df = data(spark)
    bucket = F.floor(F.col("t") / 300)
    w = Window.partitionBy("k").orderBy("t", "id")
    for excl in (True, False):
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if excl else 0)
        exp = as_map(df.withColumn("e", F.last("v", ignorenulls=True).over(frame)), "e")
        got = as_map(WB.last_non_null(df, ["k"], ["t", "id"], "v", bucket, "g", exclusive=excl), "g")
        assert got == exp


def test_retrieve_memory_buckets(spark):
    from tessera.operators.conversation import retrieve_memory
    rng = random.Random(3)
    rows = [(c, t, f"c{c}t{t}") for c in range(5) for t in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "chat int, turn long, text string")
    w = Window.partitionBy("chat").orderBy("turn").rowsBetween(-3, -1)
    exp = {(r["chat"], r["turn"]): r["c"] for r in df.withColumn("c", F.collect_list("text").over(w)).collect()}
    got = {(r["chat"], r["turn"]): r["context"] for r in
           retrieve_memory(df, "chat", "turn", "text", 3, turns_per_bucket=2).collect()}
    assert got == exp


def test_next_non_null(spark):
    df = data(spark)
    bucket = F.floor(F.col("t") / 300)
    w = Window.partitionBy("k").orderBy("t", "id")
    for excl in (True, False):
        frame = w.rowsBetween(1 if excl else 0, Window.unboundedFollowing)
        exp = as_map(df.withColumn("e", F.first("v", ignorenulls=True).over(frame)), "e")
        got = as_map(WB.next_non_null(df, ["k"], ["t", "id"], "v", bucket, "g", exclusive=excl), "g")
        assert got == exp


def nulls(spark):
    """Null keys, null order columns and null values among ordinary rows."""
    rng = random.Random(4)
    pick = lambda x: None if rng.random() < 0.25 else x
    rows = [(pick(rng.randint(0, 3)), i, pick(rng.randint(0, 900)), pick(float(rng.randint(-9, 9)))) for i in range(400)]
    return spark.createDataFrame(rows, "k int, id int, t int, v double")


def test_null_keys_and_orders_keep_their_rows(spark):
    df = nulls(spark)
    bucket, order = F.floor(F.col("t") / 100), ["t", "id"]
    w = Window.partitionBy("k").orderBy(*order)
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for got, exp in (
        (WB.running(df, ["k"], order, "v", bucket, "g"), F.sum("v").over(upto)),
        (WB.running(df, ["k"], order, "v", bucket, "g", "max", exclusive=True), F.max("v").over(before)),
        (WB.shift(df, ["k"], order, "v", bucket, "g", "lag"), F.lag("v").over(w)),
        (WB.shift(df, ["k"], order, "v", bucket, "g", "lead"), F.lead("v").over(w)),
        (WB.last_non_null(df, ["k"], order, "v", bucket, "g"), F.last("v", ignorenulls=True).over(before)),
        (WB.next_non_null(df, ["k"], order, "v", bucket, "g"), F.first("v", ignorenulls=True).over(after)),
    ):
        assert as_map(got, "g") == as_map(df.withColumn("e", exp), "e")


def test_ledger_and_conversation_keep_null_rows(spark):
    from tessera.operators import conversation, ledger

    moves = spark.createDataFrame([(None, 1, 5.0, None), (None, 2, -1.0, None), (7, 3, 2.0, None)], "item int, move_id int, qty double, ts timestamp_ntz")
    assert sorted(r["balance"] for r in ledger.stock_history(moves).collect()) == [2.0, 4.0, 5.0]
    lines = spark.createDataFrame([(None, 2.0, 3.0), (None, 1.0, 1.0), (1, 1.0, 9.0)], "sale int, q double, p double")
    assert sorted(r["grand_total"] for r in ledger.receipt(lines, "sale", "q", "p").collect()) == [7.0, 7.0, 9.0]
    ev = spark.createDataFrame([(1, None, 5.0), (2, 8, 5.0), (3, 8, 5.0), (4, 9, 5.0)], "evidence_id int, ref int, amount double")
    orders = spark.createDataFrame([(8, 5.0)], "o int, due double")
    got = {r["evidence_id"]: r["status"] for r in ledger.payment_match(ev, orders, "ref", "amount", "o", "due").collect()}
    assert got == {1: "unknown_order", 2: "matched", 3: "duplicate", 4: "unknown_order"}
    turns = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, None, "c"), (1, 1, "d")], "chat int, turn long, text string")
    got = sorted((r["text"], r["context"]) for r in conversation.retrieve_memory(turns, "chat", "turn", "text", 3).collect())
    assert got == [("a", []), ("b", ["a"]), ("c", []), ("d", ["c"])]

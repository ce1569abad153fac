"""Operators on small hand-made frames (exact expected values)."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import conversation as C, kpi as K, ledger as L, quality as Q, retrieval as R
from tessera.operators import tasks as T


def test_chunks_cover_whole_text(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, "xy")], "doc_id int, text string")
    got = [(r["doc_id"], r["chunk_no"], r["start"], r["chunk"])
           for r in R.chunk_documents(df, 4, 1).orderBy("doc_id", "chunk_no").collect()]
    assert got == [(1, 0, 0, "abcd"), (1, 1, 3, "defg"), (1, 2, 6, "ghij"), (1, 3, 9, "j"), (3, 0, 0, "xy")]
    with pytest.raises(ValueError):
        R.chunk_documents(df, 4, 4)


def test_top_terms_drop_stop_words(spark):
    df = spark.createDataFrame([("The cat and the hat",), ("cat, CAT! dog",), ("a b",)], "text string")
    got = [(r["term"], r["n"]) for r in C.top_terms(df, 3).collect()]
    assert got == [("cat", 3), ("dog", 1), ("hat", 1)]


def test_intent_first_rule_wins(spark):
    df = spark.createDataFrame([("Send a photo of my order",), ("Hello there",), ("What is the price?",),
                                ("nothing",)], "text string")
    got = [r["intent"] for r in C.intent_route(df).collect()]
    assert got == ["image_request", "greeting", "pricing", "other"]


def test_optimize_query(spark):
    df = spark.createDataFrame([("Buy the cheap Colour photo",)], "text string")
    assert R.optimize_query(df).first()["query"] == "purchase inexpensive color image"


def test_hierarchy_rolls_up(spark):
    leaf = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0)], "node string, value double")
    links = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("X", "T"), ("Y", "T")],
                                  "child string, parent string")
    got = {(r["node"], r["level"]): r["value"] for r in K.kpi_hierarchy(leaf, links, levels=3).collect()}
    assert got[("X", 2)] == 3.0 and got[("Y", 2)] == 4.0 and got[("T", 3)] == 7.0


def test_count_by_domain_keeps_zeros(spark):
    df = spark.createDataFrame([("High",), ("High",), ("Other",)], "priority string")
    got = {r["priority"]: r["n"] for r in T.count_by_domain(df, "priority", T.PRIORITIES).collect()}
    assert got == {"Low": 0, "Medium": 0, "High": 2}


def test_toggle_parity(spark):
    tasks = spark.createDataFrame([("1", False), ("2", True), ("3", False)], "id string, done boolean")
    log = spark.createDataFrame([("1",), ("1",), ("2",), ("3",), ("3",), ("3",)], "id string")
    got = {r["id"]: r["done"] for r in T.toggle_state(tasks, log).collect()}
    assert got == {"1": False, "2": False, "3": True}


def test_reconcile_returns_only_breaches(spark):
    got = spark.createDataFrame([("a", 100.0), ("b", 50.0), ("c", 10.0)], "k string, v double")
    ref = spark.createDataFrame([("a", 100.5), ("b", 60.0), ("d", 5.0)], "k string, r double")
    out = {r["k"] for r in Q.reconcile(got, ref, ["k"], "v", "r", tol=0.01).collect()}
    assert out == {"b", "c", "d"}


def test_citations_numbered_by_rank(spark):
    res = spark.createDataFrame([(1, 1, 30), (1, 2, 10), (1, 3, 30), (2, 1, 5)], "q int, rank int, src int")
    got = {r["q"]: (r["references"], r["n_sources"]) for r in R.citations(res, ["q"], "src").collect()}
    assert got == {1: ("[1] 30; [2] 10", 2), 2: ("[1] 5", 1)}


def test_normalize_posts_rules(spark):
    from tessera.operators import posts as P
    df = spark.createDataFrame([(
        "  Title ", "sum", "", [], "para one\n\n  para two \n \n\npara three", "a.png\n\n b.png \n"
    )], "title string, summary string, linkText string, groups array<string>, content_raw string, gallery_raw string")
    r = P.normalize_posts(df).first()
    assert r["title"] == "Title" and r["linkText"] == "Read note" and r["groups"] == ["recent"]
    assert r["content"] == ["para one", "para two", "para three"]
    assert r["gallery"] == ["a.png", "b.png"]
    assert P.validate_posts(spark.createDataFrame([("", "x"), ("t", ""), ("t", "s")], "title string, summary string")
                            ).count() == 1


def test_prepend_keeps_new_first_in_order(spark):
    from tessera.operators import posts as P
    base = spark.createDataFrame([("b1", 10), ("b2", 11)], "id string, pos long")
    new = spark.createDataFrame([("n1", 5), ("n2", 7)], "id string, pos long")
    got = [r["id"] for r in P.prepend(base, new).orderBy("pos").collect()]
    assert got == ["n1", "n2", "b1", "b2"]


def test_band_counts_fixed_domain(spark):
    from tessera.functions.columns import DEFAULT_LABELS, classify_bands
    df = spark.createDataFrame([(5.0,), (15.0,), (15.5,), (None,), (55.0,)], "x double") \
        .withColumn("band", classify_bands(F.col("x")))
    got = {r["band"]: r["n"] for r in T.count_by_domain(df, "band", DEFAULT_LABELS).collect()}
    assert got == {"Very Low": 1, "Low": 2, "Moderate": 0, "High": 0, "Very High": 1}


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (5.0, None), (3.0, "b"), (float("nan"), "b")],
                               "x double, s string")
    mean = [r["x"] for r in Q.impute(df, ["x"], "mean").collect()]
    median = [r["x"] for r in Q.impute(df, ["x"], "median").collect()]
    mode = [r["s"] for r in Q.impute(df, ["s"], "mode").collect()]
    const = [r["s"] for r in Q.impute(df, ["s"], "constant", "zz").collect()]
    assert mean == [1.0, 3.0, 5.0, 3.0, 3.0] and median == [1.0, 3.0, 5.0, 3.0, 3.0]
    assert mode == ["a", "b", "b", "b", "b"] and const == ["a", "b", "zz", "b", "b"]
    assert Q.impute(df, ["s"], "drop").count() == 4


def test_stock_cover(spark):
    pos = spark.createDataFrame([("a", 30.0), ("b", 5.0)], "item string, stock double")
    moves = spark.createDataFrame([("a", "2024-01-20 00:00:00", -15.0), ("a", "2023-01-01 00:00:00", -99.0)],
                                  "item string, ts string, qty double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["item"]: r["days_of_cover"] for r in
           L.stock_cover(pos, moves, "item", "ts", "qty", "2024-01-31 00:00:00", days=30).collect()}
    assert got == {"a": 60.0, "b": None}

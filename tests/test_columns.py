"""Column functions on the hand-made edge frames of FIXTURES part 3."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import links as LK, posts as P, tasks as T


def col_values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_bands_edges(spark):
    vals = [9.99, 10.0, 19.99, 20.0, 29.99, 30.0, 39.99, 40.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    out = df.orderBy("i").select(C.classify_bands(F.col("x")).alias("b"))
    assert col_values(out, "b") == ["Very Low", "Low", "Low", "Moderate", "Moderate", "High", "High",
                                    "Very High", None]


def test_to_number_text_cells(spark):
    df = spark.createDataFrame([("12.5",), ("n/a",), (None,), ("NaN",), ("-0",)], "s string")
    out = [r[0] for r in df.select(C.to_number("s")).collect()]
    assert out[0] == 12.5 and out[1] is None and out[2] is None and out[3] is None and out[4] == 0.0


def test_due_dates_roll_over(spark):
    texts = ["2024-02-29", "2024-02-31", "2024-13-01", "0050-01-01", "24-1-1", "", None, "2024-01-00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    got = [r[0] for r in df.orderBy("i").select(C.parse_due_date(F.col("d"))).collect()]
    eod = dt.time(23, 59, 59, 999000)
    assert got[0] == dt.datetime.combine(dt.date(2024, 2, 29), eod)
    assert got[1] == dt.datetime.combine(dt.date(2024, 3, 2), eod)
    assert got[2] == dt.datetime.combine(dt.date(2025, 1, 1), eod)
    assert got[3] == dt.datetime.combine(dt.date(1950, 1, 1), eod)
    assert got[4] is None and got[5] is None and got[6] is None
    assert got[7] == dt.datetime.combine(dt.date(2023, 12, 31), eod)


def test_overdue_rules(spark):
    rows = [(False, "2024-01-01"), (True, "2024-01-01"), (False, ""), (False, "bad"), (False, "2024-06-01"),
            (False, "2024-03-01")]
    df = spark.createDataFrame(rows, "done boolean, due string")
    got = col_values(df.select(C.is_overdue(F.col("done"), F.col("due"), "2024-03-01 23:59:59.999").alias("o")), "o")
    # strictly before now: the day that ends exactly at now is not overdue
    assert got == [True, False, False, False, False, False]


def test_titles_validation(spark):
    titles = ["", "   ", "x" * 120, "x" * 121, "\U0001F600 party", "ok"]
    dues = ["", "", "", "", "", "2024-02-31x"]
    df = spark.createDataFrame(list(zip(range(6), titles, dues)), "i int, title string, due string")
    got = col_values(T.validate_tasks(df).orderBy("i"), "error")
    assert got == [T.MSG_TITLE_REQUIRED, T.MSG_TITLE_REQUIRED, None, T.MSG_TITLE_TOO_LONG, None, T.MSG_DUE_INVALID]


def test_tags(spark):
    twelve = ",".join(f"t{i}" for i in range(12))
    df = spark.createDataFrame([(0, "a, a,,b"), (1, twelve), (2, None), (3, " x\t, y ,x")], "i int, s string")
    got = col_values(df.orderBy("i").select(C.normalize_tags(F.col("s")).alias("t")), "t")
    assert got[0] == ["a", "b"]
    assert got[1] == [f"t{i}" for i in range(10)]
    assert got[2] == []
    assert got[3] == ["x", "y"]


def test_search_needle_is_literal(spark):
    df = spark.createDataFrame([("a.c", "", "Low", ["x"], ""), ("abc", "", "Low", ["y"], "")],
                               "title string, due string, priority string, tags array<string>, notes string")
    assert T.search_rows(df, "A.C").count() == 1
    assert T.search_rows(df, "   ").count() == 2
    assert T.search_rows(df, "x").count() == 1


def test_employee_search_refuses_blank(spark):
    import pytest
    df = spark.createDataFrame([(1, "Ann")], "id int, name string")
    with pytest.raises(ValueError):
        T.employee_search(df, "   ", "id", "name")
    assert T.employee_search(df, " an ", "id", "name").count() == 1


def test_formulas_neutralised(spark):
    vals = ["=1+1", "+a", "-1", "@x", "plain", "\tx"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(C.csv_safe(F.col("s"))).collect()]
    assert got == ["'=1+1", "'+a", "'-1", "'@x", "plain", "'\tx"]


def test_clean_names():
    assert C.clean_name("ISOCode") == "iso_code"
    assert C.clean_name("AcctBal (USD)") == "acct_bal_usd"
    assert C.clean_name("mkt-segment") == "mkt_segment"
    assert C.clean_name("2020 value") == "x2020_value"
    assert C.clean_name("") == "x"


def test_read_minutes(spark):
    df = spark.createDataFrame([("6m",), ("6 m",), ("12m ",), (None,)], "r string")
    assert [r[0] for r in df.select(C.parse_read_minutes("r")).collect()] == [6, None, 12, None]


def test_paths(spark):
    urls = ["/index.html", "/blog.html?x=1#top", "/a/b", "/Notes/INDEX.HTML", "https://h.example.com/p.html#z"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [r[0] for r in df.orderBy("i").select(LK.canonical_url(F.col("u"))).collect()]
    assert got == ["/", "/blog?x=1#top", "/a/b", "/Notes/", "/p#z"]
    res = ["/consultation/", "", "/", "/a.pdf", "/x?q=1"]
    df2 = spark.createDataFrame([(i, u) for i, u in enumerate(res)], "i int, u string")
    got2 = [r[0] for r in df2.orderBy("i").select(LK.resolve_path(F.col("u"))).collect()]
    assert got2 == ["/consultation.html", "/", "/", "/", "/x.html?q=1"]


def test_links_frame(spark):
    hrefs = ["rel/page", "https://site.example.com/a", "https://other.example.org/b", "mailto:a@b.c",
             "tel:123", "#top", "http://", "", "/root", "./x"]
    df = spark.createDataFrame([(i, "https://site.example.com/", h) for i, h in enumerate(hrefs)],
                               "anchor_no int, url string, href string")
    kinds = [r[0] for r in LK.classify_links(df).orderBy("anchor_no").select("link_kind").collect()]
    assert kinds == ["internal", "internal", "external", "skipped", "skipped", "skipped", "malformed",
                     "skipped", "skipped", "internal"]
    routes = LK.routable_links(df).orderBy("anchor_no").select("routable", "route_target").collect()
    assert routes[0] == (True, "/rel/page.html")
    assert routes[8] == (True, "/root.html")
    assert routes[9][0] is False  # contains '.'
    assert routes[1][0] is False and routes[3][0] is False and routes[5][0] is False


def test_groups_filter(spark):
    df = spark.createDataFrame([(0, ["recent", "notes"], "all"), (1, ["data notes"], "ai"), (2, [], "ai")],
                               "i int, groups array<string>, topic string")
    got = sorted(r[0] for r in P.filter_posts(df, "notes").collect())
    assert got == [0, 1]
    assert [r[0] for r in P.filter_posts(df, "notes", "ai").collect()] == [1]


def test_post_meta_skips_absent(spark):
    df = spark.createDataFrame([("x", "6m", ""), ("", "", "draft")], "category string, read string, status string")
    got = [r[0] for r in P.post_meta(df).select("meta").collect()]
    assert got == ["category: x | read: 6m", "status: draft"]

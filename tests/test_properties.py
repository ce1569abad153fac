"""Property tests: generated inputs, one Spark job per property."""

import datetime as dt
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions.columns import classify_bands, normalize_tags, parse_due_date

EOD = dt.timedelta(hours=23, minutes=59, seconds=59, milliseconds=999)


def model_due(text):
    """Calendar model of the due-date rule: 4-2-2 digits and nothing else, years
    below 100 are 19xx, months and days roll over."""
    if text is None or not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        return None
    y, m, d = (int(p) for p in text.split("-"))
    if y < 100:
        y += 1900
    yy, mm = divmod(y * 12 + (m - 1), 12)
    return dt.datetime(yy, mm + 1, 1) + dt.timedelta(days=d - 1) + EOD


dates = st.tuples(st.integers(0, 9980), st.integers(0, 99), st.integers(0, 99)).map(
    lambda t: f"{t[0]:04d}-{t[1]:02d}-{t[2]:02d}")
noise = st.sampled_from(["", " ", " 2024-01-01", "2024-01-01 ", "2024-01-01\n", "2024-1-01", "24-01-01", "2024/01/01", "abcd-ef-gh", None])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(dates, noise), min_size=1, max_size=300))
def test_due_dates_follow_the_calendar_model(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    got = [r[0] for r in df.orderBy("i").select(parse_due_date(F.col("d"))).collect()]
    assert got == [model_due(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 200, allow_nan=False)), min_size=1, max_size=300))
def test_bands_follow_the_cuts(spark, xs):
    def model(x):
        if x is None:
            return None
        for cut, label in ((10, "Very Low"), (20, "Low"), (30, "Moderate"), (40, "High")):
            if x < cut:
                return label
        return "Very High"
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(classify_bands(F.col("x"))).collect()]
    assert got == [model(x) for x in xs]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", " c", "d ", "", "  ", "é", "x y"]), max_size=15)
                .map(lambda parts: ",".join(parts)), min_size=1, max_size=100))
def test_tags_first_occurrence_distinct(spark, texts):
    def model(t):
        out = []
        for p in t.split(","):
            p = p.strip(" \t\n\r\f\x0b")
            if p and p not in out:
                out.append(p)
        return out[:10]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(normalize_tags(F.col("s"))).collect()]
    assert got == [model(t) for t in texts]

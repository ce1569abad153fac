"""Ordered per-key windows that do not put a hot key into one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts every row of a key
in one task. When a key can hold a third of all rows, these helpers split
the key into ordered buckets (a column that never decreases along the
order, e.g. the week of the timestamp): the window runs per
``(key, bucket)``, and what crosses bucket edges comes from one small
aggregate per bucket (a running total of previous buckets, the last value
of the previous bucket, ...) joined back. Rows with a null key or a null order
column keep their place: nulls form a key, and a bucket that comes first. The only window over a whole key
runs over its buckets, one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same name in which null equals null; the
    key columns of ``left`` are kept once."""
    names = {c: f"_r{i}_{c}" for i, c in enumerate(on)}
    r = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    cond = [left[c].eqNullSafe(r[names[c]]) for c in on]
    return left.join(r, cond, how).drop(*names.values())


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def running(df: DataFrame, key: Sequence[str], order: Sequence, value: str, bucket: Column,
            name: str, fn: str = "sum", exclusive: bool = False) -> DataFrame:
    """Running ``sum``/``max``/``min`` of ``value`` per key in ``order``;
    ``exclusive`` leaves the current row out."""
    key = list(key)
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[fn]
    b = df.withColumn("_b", bucket)
    tot = b.groupBy(*key, "_b").agg(agg(value).alias("_bt"))
    prev = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_off", agg("_bt").over(prev)).drop("_bt")
    end = -1 if exclusive else Window.currentRow
    inner = Window.partitionBy(*key, "_b").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, end)
    run = agg(value).over(inner)
    if fn == "sum":
        combined = F.when(run.isNull() & F.col("_off").isNull(), F.lit(None)) \
            .otherwise(F.coalesce(F.col("_off"), F.lit(0)) + F.coalesce(run, F.lit(0)))
    elif fn == "max":
        combined = F.greatest(F.col("_off"), run)
    else:
        combined = F.least(F.col("_off"), run)
    return null_safe_join(b, tot, key + ["_b"]).withColumn(name, combined).drop("_b", "_off")


def shift_many(df: DataFrame, key: Sequence[str], order: Sequence, bucket: Column,
               specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Several lag/lead columns in one pass: ``specs`` is a list of
    ``(value, name, 'lag' | 'lead')``. One edge aggregate per bucket, one
    join, one window partitioning."""
    key = list(key)
    b = df.withColumn("_b", bucket)
    ordk = F.struct(*_cols(order))
    w = Window.partitionBy(*key, "_b").orderBy(*_cols(order))
    aggs = []
    for i, (value, _name, direction) in enumerate(specs):
        pick = F.max_by if direction == "lag" else F.min_by
        aggs.append(pick(F.col(value), ordk).alias(f"_e{i}"))
    wb = Window.partitionBy(*key).orderBy("_b")
    edges = b.groupBy(*key, "_b").agg(*aggs)
    edges = edges.select(*key, "_b", *[
        (F.lag(f"_e{i}") if d == "lag" else F.lead(f"_e{i}")).over(wb).alias(f"_e{i}")
        for i, (_v, _n, d) in enumerate(specs)])
    # first / last row of a bucket, from the same window (no second partitioning)
    out = null_safe_join(b, edges, key + ["_b"]) \
        .withColumn("_first_row", F.lag(F.lit(1)).over(w).isNull()) \
        .withColumn("_last_row", F.lead(F.lit(1)).over(w).isNull())
    for i, (value, name, direction) in enumerate(specs):
        if direction == "lag":
            out = out.withColumn(name, F.when(F.col("_first_row"), F.col(f"_e{i}")).otherwise(F.lag(value).over(w)))
        else:
            out = out.withColumn(name, F.when(F.col("_last_row"), F.col(f"_e{i}")).otherwise(F.lead(value).over(w)))
    return out.drop("_b", "_first_row", "_last_row", *[f"_e{i}" for i in range(len(specs))])


def shift(df: DataFrame, key: Sequence[str], order: Sequence, value: str, bucket: Column,
          name: str, direction: str = "lag") -> DataFrame:
    """``lag`` (previous row's value) or ``lead`` (next row's value) per key
    in ``order``; rows at a bucket edge take the neighbour bucket's edge
    value."""
    return shift_many(df, key, order, bucket, [(value, name, direction)])


def next_non_null(df: DataFrame, key: Sequence[str], order: Sequence, value: str, bucket: Column,
                  name: str, exclusive: bool = True) -> DataFrame:
    """The first non-null ``value`` after (``exclusive``) or from the
    current row on, per key in ``order``."""
    key = list(key)
    b = df.withColumn("_b", bucket)
    ordk = F.struct(*_cols(order))
    first_in = b.filter(F.col(value).isNotNull()).groupBy(*key, "_b").agg(
        F.min_by(F.col(value), ordk).alias("_bf"))
    buckets = null_safe_join(b.select(*key, "_b").distinct(), first_in, key + ["_b"], "left")
    nxt = Window.partitionBy(*key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    buckets = buckets.withColumn("_carry", F.first("_bf", ignorenulls=True).over(nxt)).drop("_bf")
    start = 1 if exclusive else Window.currentRow
    inner = Window.partitionBy(*key, "_b").orderBy(*_cols(order)).rowsBetween(start, Window.unboundedFollowing)
    return (null_safe_join(b, buckets, key + ["_b"])
            .withColumn(name, F.coalesce(F.first(value, ignorenulls=True).over(inner), F.col("_carry")))
            .drop("_b", "_carry"))


def last_non_null(df: DataFrame, key: Sequence[str], order: Sequence, value: str, bucket: Column,
                  name: str, exclusive: bool = True) -> DataFrame:
    """The last non-null ``value`` before (``exclusive``) or up to the
    current row per key in ``order``."""
    key = list(key)
    b = df.withColumn("_b", bucket)
    ordk = F.struct(*_cols(order))
    last_in = b.filter(F.col(value).isNotNull()).groupBy(*key, "_b").agg(
        F.max_by(F.col(value), ordk).alias("_bl"))
    buckets = null_safe_join(b.select(*key, "_b").distinct(), last_in, key + ["_b"], "left")
    prev = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_carry", F.last("_bl", ignorenulls=True).over(prev)).drop("_bl")
    end = -1 if exclusive else Window.currentRow
    inner = Window.partitionBy(*key, "_b").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, end)
    return (null_safe_join(b, buckets, key + ["_b"])
            .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inner), F.col("_carry")))
            .drop("_b", "_carry"))

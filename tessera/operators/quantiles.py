"""Exact quantiles of any column size and group count, as one plan.

Spark's exact ``percentile`` keeps a value -> count map of a whole group in one
reducer; ``percentile_approx`` is bounded but not exact. Here the sketch only
says where to look:

1. one sketch aggregate per group gives, for each probability p, values at
   p - d and p + d; with an accuracy of 4 / d their rank errors are d / 4 of
   the rows, so the wanted ranks lie between them. A group of up to 16 / d rows
   has no bracket: it is its own candidate set. So there is at most one row of brackets
   for 16 / d rows of input, and they are sent to the rows: rows never go by group;
2. one aggregate counts the rows below and above each bracket and the rows of each value
   inside it (about 2 d of the rows);
3. a running count over a group's bracketed values gives the values at the
   ranks floor(h) and ceil(h), h = (n - 1) p.

Interpolation is R type 7 (DuckDB ``quantile_cont``): linear between those
values. Nothing runs while the plan is built and nothing passes through the
driver; the same plan serves every size. NaN counts as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import nan_to_null

#: Half width of a bracket, as a share of the rows of its group.
HALF = 4e-4


def grouped_quantiles(df: DataFrame, col: str, by: Sequence[str], probs: Sequence[float], half: float = HALF) -> DataFrame:
    """``(by..., _q0, _q1, ...)``: exact quantiles of the non-missing values of
    every group that has any. Null keys are a group."""
    from tessera.operators.windows import null_safe_join

    by = list(by)
    x = nan_to_null(F.col(col).cast("double")).alias("_x")
    v = df.select(*by, x).filter(F.col("_x").isNotNull())
    edges = [e for p in probs for e in (max(0.0, p - half), min(1.0, p + half))]
    groups = v.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", edges, int(4 / half)).alias("_e"))
    large = groups.filter(F.col("_n") > int(16 / half))
    bracket = lambda lo, hi: F.array(*[F.struct(F.lit(i).alias("i"), lo(i).alias("lo"), hi(i).alias("hi")) for i in range(len(probs))])
    none = F.lit(None).cast("double")
    targets = large.select(*by, bracket(lambda i: F.col("_e")[2 * i], lambda i: F.col("_e")[2 * i + 1]).alias("_t"))
    # the brackets go to the rows, of which a few groups may hold all; without groups they are one scalar
    rows = null_safe_join(v, F.broadcast(targets), by, "left") if by else v.withColumn("_t", targets.select("_t").scalar())
    rows = rows.select(*by, "_x", F.explode(F.coalesce("_t", bracket(lambda i: none, lambda i: none))).alias("_t"))
    # rows below a bracket count together, under a null value that sorts first, rows above it under NaN, which sorts last
    place = F.when(F.col("_t.lo").isNull(), F.col("_x")).when(F.col("_x") > F.col("_t.hi"), F.lit(float("nan"))).when(F.col("_x") >= F.col("_t.lo"), F.col("_x"))
    counts = rows.groupBy(*by, F.col("_t.i").alias("_i"), place.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by, "_i")
    p = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
    counts = counts.withColumn("_upto", F.sum("_c").over(group.orderBy("_v"))).withColumn("_h", (F.sum("_c").over(group) - 1) * p)
    ranks = counts.groupBy(*by, "_i", (F.col("_h") - F.floor("_h")).alias("_part")).agg(
        F.min(F.when(F.col("_upto") > F.floor("_h"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.ceil("_h"), F.col("_v"))).alias("_b"))
    value = F.when(F.col("_part") > 0, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).otherwise(F.col("_a"))
    return ranks.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, value)).alias(f"_q{i}") for i in range(len(probs))])


def column_quantiles(df: DataFrame, col: str, probs: Sequence[float], half: float = HALF) -> list[Column]:
    """Quantiles of a whole column as columns usable on every row: one scalar
    subquery, shared by all of them; null for a column without values."""
    q = grouped_quantiles(df, col, (), probs, half)
    names = [f"_q{i}" for i in range(len(probs))]
    one = q.select(F.struct(*names).alias("s")).scalar()
    return [one[n] for n in names]

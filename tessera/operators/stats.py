"""Descriptive statistics (D-1 .. D-5, D-18, D-27 .. D-31, E-5, F-8).

Plan shape: each statistic is one aggregate with map-side partial
aggregation. When a per-row test needs a statistic (fences, bin width), the
statistic is a *scalar subquery* (``DataFrame.scalar()``): Spark runs it once,
ships the single value to the tasks and can push it into the parquet scan. No
cross join, no driver round trip.

Quantiles (linear interpolation between closest ranks, the same as R type 7
and DuckDB ``quantile_cont``): ``method="exact"`` brackets the wanted ranks with
a sketch and counts inside the brackets (:mod:`tessera.operators.quantiles`),
for any size and any number of groups. ``method="approx"`` uses
``percentile_approx``; it returns an actual data value and does not interpolate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import nan_to_null
from tessera.operators.quantiles import column_quantiles, grouped_quantiles
from tessera.operators.windows import null_safe_join

QUARTILES = (0.25, 0.5, 0.75)


def global_quantiles(df: DataFrame, col: str, probs: Sequence[float], method: str = "exact",
                     accuracy: int = 10000) -> list[Column]:
    """Whole-column quantiles as columns usable on every row (one scalar
    subquery): 'exact' at any size, or 'approx' (``percentile_approx``)."""
    if method == "exact":
        return column_quantiles(df, col, probs)
    if method != "approx":
        raise ValueError("method must be 'exact' or 'approx'")
    x = nan_to_null(F.col(col).cast("double"))
    q = df.select(F.percentile_approx(x, list(probs), accuracy).alias("q")).scalar()
    return [q[i].cast("double") for i in range(len(probs))]


def columns_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "exact") -> dict[str, list[Column]]:
    """Whole-column quantiles of several columns by one plan and one scalar
    subquery: :func:`global_quantiles` for each, in a single pass over the rows."""
    if method != "exact":
        return {c: global_quantiles(df, c, probs, method) for c in cols}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x"))
                                         for i, c in enumerate(cols)])).alias("s")).select("s.i", "s.x")
    names = [f"_q{j}" for j in range(len(probs))]
    q = grouped_quantiles(long, "x", ["i"], probs)
    one = q.agg(*[F.max(F.when(F.col("i") == i, F.struct(*names))).alias(f"c{i}") for i in range(len(cols))])
    s = one.select(F.struct("*").alias("s")).scalar()
    return {c: [s[f"c{i}"][n] for n in names] for i, c in enumerate(cols)}


def describe_numeric(df: DataFrame, col: str, by: Sequence[str] = (),
                     method: str = "exact", accuracy: int = 10000,
                     strict_nulls: bool = False) -> DataFrame:
    """n, n_missing, mean, median, min, max, sample sd/variance, Q1, Q3, IQR (D-1).

    ``n`` counts rows including missing ones. Missing values (null or NaN)
    are skipped by the statistics; ``strict_nulls=True`` returns null
    statistics for a group that has any missing value instead.
    """
    x = nan_to_null(F.col(col).cast("double"))
    base = [F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("_x").isNull()).alias("n_missing"),
            F.avg("_x").alias("mean"),
            F.min("_x").alias("min"),
            F.max("_x").alias("max"),
            F.stddev_samp("_x").alias("sd"),
            F.var_samp("_x").alias("variance")]
    rows = df.select(*by, x.alias("_x"))
    if method == "approx":
        agg = rows.groupBy(*by).agg(*base, F.percentile_approx("_x", list(QUARTILES), accuracy).alias("_q"))
        q1, med, q3 = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    elif by:
        agg = null_safe_join(rows.groupBy(*by).agg(*base), grouped_quantiles(df, col, by, QUARTILES), list(by), "left")
        q1, med, q3 = F.col("_q0"), F.col("_q1"), F.col("_q2")
    else:
        q1, med, q3 = global_quantiles(df, col, QUARTILES, method)
        agg = rows.agg(*base)
    out = agg.select(
        *by, "n", "n_missing", "mean",
        med.alias("median"), "min", "max", "sd", "variance",
        q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"))
    if strict_nulls:
        stat_cols = ["mean", "median", "min", "max", "sd", "variance", "q1", "q3", "iqr"]
        out = out.select(*by, "n", "n_missing",
                         *[F.when(F.col("n_missing") == 0, F.col(s)).alias(s) for s in stat_cols])
    return out


def summary_overview(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """Per-column structure summary (D-2): name, type, rows, missing, distinct,
    min and max as text. One aggregate pass, then an unpivot.

    Distinct counts are HyperLogLog (``approx_count_distinct``) unless
    ``exact_distinct``: then each column's values are grouped by a plan of their own
    that reads this column alone, so a task holds distinct values of one column, and
    the rows are not copied once per column.
    """
    cols = df.columns
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        col = F.col(c)
        miss = (col.isNull() | F.isnan(col)) if types[c] in ("double", "float") else col.isNull()
        orderable = not types[c].startswith(("array", "map", "struct", "binary"))
        aggs += [F.count_if(miss).alias(f"_m{i}"), *([] if exact_distinct else [F.approx_count_distinct(col).alias(f"_d{i}")]),
                 (F.min(col).cast("string") if orderable else F.lit(None).cast("string")).alias(f"_lo{i}"),
                 (F.max(col).cast("string") if orderable else F.lit(None).cast("string")).alias(f"_hi{i}")]
    wide = df.agg(*aggs)
    if exact_distinct:
        values = [df.select(F.col(c).alias("_v")).distinct() for c in cols]
        wide = wide.select("*", *[v.agg(F.count("_v")).scalar().alias(f"_d{i}") for i, v in enumerate(values)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                 F.lit(types[c]).alias("data_type"),
                 F.col(f"_m{i}").alias("n_missing"), F.col(f"_d{i}").cast("long").alias("n_distinct"),
                 F.col(f"_lo{i}").alias("min_value"), F.col(f"_hi{i}").alias("max_value"))
        for i, c in enumerate(cols)])
    return (wide.select(F.col("_rows").alias("n_rows"), F.inline(rows))
            .select("position", "column_name", "data_type", "n_rows", "n_missing",
                    "n_distinct", "min_value", "max_value"))


def first_rows(df: DataFrame, order: Sequence[str], n: int = 6) -> DataFrame:
    """The first n rows in a given order (D-2): a top-n, never a global sort."""
    return df.orderBy(*order).limit(n)


def missing_by_column(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count per column, NaN counted as missing for float columns (D-3).

    Single pass: one ``count_if`` per column, then unpivot to
    ``(column_name, n_missing)``.
    """
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    exprs = []
    for c in cols:
        col = F.col(c)
        miss = (col.isNull() | F.isnan(col)) if types[c] in ("double", "float") else col.isNull()
        exprs.append(F.count_if(miss).alias(c))
    wide = df.agg(*exprs)
    return wide.unpivot([], cols, "column_name", "n_missing")


def histogram(df: DataFrame, col: str, bins: int = 20, method: str = "exact") -> DataFrame:
    """Equal-width histogram with empty bins kept (D-4).

    Bin i covers ``[min + i*w, min + (i+1)*w)``, the last bin is closed; an
    all-equal column puts every row into bin 0. Each row also carries the
    mean and median of the column as reference lines.
    """
    x = nan_to_null(F.col(col).cast("double"))
    vals = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    # one scalar subquery (a struct) reused for every field below
    st = vals.select(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"),
                              F.avg("_x").alias("mean")).alias("s")).scalar()
    (median,) = global_quantiles(df, col, [0.5], method)
    lo, hi = st["lo"], st["hi"]
    width = (hi - lo) / F.lit(bins)
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - lo) / width), F.lit(bins - 1))).cast("int")
    counts = vals.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    domain = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (domain.join(counts, "bin", "left")
            .select("bin",
                    (lo + F.col("bin") * width).alias("bin_lo"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n"),
                    st["mean"].alias("mean"), median.alias("median")))


def quartile_fences(df: DataFrame, col: str, k: float = 1.5, method: str = "exact"):
    """Columns ``(q1, q3, lower_fence, upper_fence)`` usable on every row
    (one scalar subquery)."""
    q1, q3 = global_quantiles(df, col, (0.25, 0.75), method)
    return q1, q3, q1 - F.lit(k) * (q3 - q1), q3 + F.lit(k) * (q3 - q1)


def boxplot_stats(df: DataFrame, col: str, k: float = 1.5, method: str = "exact") -> DataFrame:
    """Box: quartiles, whiskers at the most extreme values inside the 1.5 IQR
    fences, outlier counts below/above (D-5). One row."""
    x = nan_to_null(F.col(col).cast("double"))
    q1, median, q3 = global_quantiles(df, col, QUARTILES, method)
    lo_f, hi_f = q1 - F.lit(k) * (q3 - q1), q3 + F.lit(k) * (q3 - q1)
    v = df.select(x.alias("_x")).filter(F.col("_x").isNotNull())
    return v.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_x").alias("min"),
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_high"),
        F.max("_x").alias("max"),
        F.count_if(F.col("_x") < lo_f).alias("n_out_low"),
        F.count_if(F.col("_x") > hi_f).alias("n_out_high"),
    ).select("n", "min", q1.alias("q1"), median.alias("median"), q3.alias("q3"),
             lo_f.alias("lower_fence"), hi_f.alias("upper_fence"),
             "whisker_low", "whisker_high", "max", "n_out_low", "n_out_high")


def distribution_label(df: DataFrame, col: str, tol: float = 0.0, method: str = "exact") -> DataFrame:
    """Mean, median, skewness and a label (E-5): mean above median reads as
    positive skew, below as negative, else symmetric."""
    x = nan_to_null(F.col(col).cast("double"))
    (median,) = global_quantiles(df, col, [0.5], method)
    s = df.select(x.alias("_x")).agg(F.avg("_x").alias("mean"),
                                    F.skewness("_x").alias("skewness")).withColumn("median", median)
    diff = F.col("mean") - F.col("median")
    return s.withColumn(
        "label",
        F.when(diff > tol, "positive skew").when(diff < -tol, "negative skew")
        .when(diff.isNotNull(), "symmetric"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair (D-18), one aggregate
    pass, long format ``(col_a, col_b, corr)``."""
    cols = list(cols)
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_{i}")
                    for i, (a, b) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                             F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(arr))


def confidence_band(df: DataFrame, by: Sequence[str], col: str, z: float = 1.96,
                    min_n: int = 30) -> DataFrame:
    """Mean +/- z*sd/sqrt(n) per group, flagged when n < min_n (F-8)."""
    x = nan_to_null(F.col(col).cast("double"))
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"),
                            F.stddev_samp(x).alias("sd"))
    half = F.lit(z) * F.try_divide(F.col("sd"), F.sqrt(F.col("n")))
    return g.select(*by, "n", "mean", (F.col("mean") - half).alias("lower"),
                    (F.col("mean") + half).alias("upper"),
                    (F.col("n") < min_n).alias("low_volume"))


def wilson_interval(successes: Column, n: Column, z: float = 1.96):
    """Wilson score interval for a rate; returns ``(low, high)`` columns."""
    p = successes / n
    zz = F.lit(z * z)
    denom = 1 + zz / n
    centre = (p + zz / (2 * n)) / denom
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / denom
    return centre - half, centre + half


def incidence_rates(df: DataFrame, by: Sequence[str], cases: str, person_time: str,
                    z: float = 1.96) -> DataFrame:
    """Cases per unit person-time per group with a log-normal (Poisson) CI (D-27)."""
    g = df.groupBy(*by).agg(F.sum(cases).alias("cases"), F.sum(person_time).alias("person_time"))
    rate = F.try_divide(F.col("cases"), F.col("person_time"))
    se = F.try_divide(F.lit(1.0), F.sqrt(F.col("cases")))
    return g.select(*by, "cases", "person_time", rate.alias("rate"),
                    (rate * F.exp(-F.lit(z) * se)).alias("rate_low"),
                    (rate * F.exp(F.lit(z) * se)).alias("rate_high"))


def rate_ratio(rates: DataFrame, group_col: str, exposed, reference) -> DataFrame:
    """Rate ratio exposed/reference of an :func:`incidence_rates` result."""
    r = rates.agg(
        F.max(F.when(F.col(group_col) == F.lit(exposed), F.col("rate"))).alias("rate_exposed"),
        F.max(F.when(F.col(group_col) == F.lit(reference), F.col("rate"))).alias("rate_reference"))
    return r.withColumn("rate_ratio", F.try_divide(F.col("rate_exposed"), F.col("rate_reference")))


def diff_in_diff(df: DataFrame, outcome: str, treated: str, post: str) -> DataFrame:
    """2x2 difference-in-differences of group means (D-28)."""
    y = F.col(outcome).cast("double")
    t, p = F.col(treated).cast("boolean"), F.col(post).cast("boolean")
    m = df.agg(F.avg(F.when(t & p, y)).alias("treated_post"),
               F.avg(F.when(t & ~p, y)).alias("treated_pre"),
               F.avg(F.when(~t & p, y)).alias("control_post"),
               F.avg(F.when(~t & ~p, y)).alias("control_pre"))
    return m.withColumn("did", (F.col("treated_post") - F.col("treated_pre"))
                        - (F.col("control_post") - F.col("control_pre")))


def rdd_estimate(df: DataFrame, outcome: str, running: str, cutoff: float,
                 bandwidth: float) -> DataFrame:
    """Sharp regression discontinuity, local linear fit on each side (D-29).

    Jump = intercept_right - intercept_left, both regressions of the outcome
    on ``running - cutoff`` within the bandwidth.
    """
    x = F.col(running).cast("double") - F.lit(cutoff)
    y = F.col(outcome).cast("double")
    w = df.select(x.alias("_x"), y.alias("_y")).filter(F.abs(F.col("_x")) <= bandwidth)
    left, right = F.col("_x") < 0, F.col("_x") >= 0
    r = w.agg(
        F.regr_intercept(F.when(left, F.col("_y")), F.when(left, F.col("_x"))).alias("intercept_left"),
        F.regr_slope(F.when(left, F.col("_y")), F.when(left, F.col("_x"))).alias("slope_left"),
        F.regr_intercept(F.when(right, F.col("_y")), F.when(right, F.col("_x"))).alias("intercept_right"),
        F.regr_slope(F.when(right, F.col("_y")), F.when(right, F.col("_x"))).alias("slope_right"),
        F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"))
    return r.withColumn("jump", F.col("intercept_right") - F.col("intercept_left"))


def shrunk_means(df: DataFrame, group: str, col: str) -> DataFrame:
    """Empirical-Bayes partial pooling of group means (D-31).

    weight = tau2 / (tau2 + s2/n) with s2 the pooled within-group variance and
    tau2 the between-group variance of the means (method of moments, floored
    at 0); shrunk = weight*mean + (1-weight)*grand_mean.
    """
    x = F.col(col).cast("double")
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"),
                              F.var_samp(x).alias("var"))
    grand = df.select(F.avg(x)).scalar()
    within = g.select(F.try_divide(F.sum((F.col("n") - 1) * F.col("var")),
                                   F.sum(F.col("n") - 1))).scalar()
    between = g.select(F.var_samp("mean")).scalar()
    avg_inv_n = g.select(F.avg(1 / F.col("n"))).scalar()
    tau2 = F.greatest(between - within * avg_inv_n, F.lit(0.0))
    weight = F.try_divide(tau2, tau2 + F.try_divide(within, F.col("n")))
    return g.select(group, "n", "mean",
                    F.coalesce(weight, F.lit(0.0)).alias("weight"),
                    (F.coalesce(weight, F.lit(0.0)) * F.col("mean")
                     + (1 - F.coalesce(weight, F.lit(0.0))) * grand).alias("shrunk_mean"))

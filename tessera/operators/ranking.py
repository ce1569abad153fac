"""Sorts, top-k and windows (F-1 .. F-13).

Conventions: every ranking carries an explicit tie-break key (Spark has no
stable order); "descending, missing last" is ``desc_nulls_last``.

Top-k over a whole table is ``orderBy(...).limit(k)`` which Spark plans as
``TakeOrderedAndProject`` (a per-partition heap, then a merge of k rows
per partition). Top-k per group uses two stages: first within
``(group, salt)`` buckets, then over the surviving candidates, so a group
holding a third of all rows is ranked by many tasks, not one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALT_BUCKETS = 32


def _order(col: str, desc: bool, tiebreak: Sequence[str]) -> list[Column]:
    main = F.col(col).desc_nulls_last() if desc else F.col(col).asc_nulls_last()
    return [main] + [F.col(t).asc_nulls_last() for t in tiebreak]


def sort_by(df: DataFrame, col: str, desc: bool = True, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Sort, missing last, then by the tie-break keys (F-1)."""
    return df.orderBy(*_order(col, desc, tiebreak))


def top_k(df: DataFrame, col: str, k: int, tiebreak: Sequence[str] = (), desc: bool = True) -> DataFrame:
    """Exactly k rows (no tie expansion), missing last (F-2)."""
    return df.orderBy(*_order(col, desc, tiebreak)).limit(k)


def bottom_k(df: DataFrame, col: str, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    return top_k(df, col, k, tiebreak, desc=False)


def bar_order(df: DataFrame, col: str, tiebreak: Sequence[str] = (), desc: bool = True,
              name: str = "bar_pos") -> DataFrame:
    """Display position of each category by its measure (F-3). Meant for a
    top-k result (small); uses an unpartitioned window."""
    w = Window.orderBy(*_order(col, desc, tiebreak))
    return df.withColumn(name, F.row_number().over(w))


def top_k_per_group(df: DataFrame, group: Sequence[str], col: str, k: int,
                    tiebreak: Sequence[str] = (), desc: bool = True, ties: bool = False,
                    salt_buckets: int = DEFAULT_SALT_BUCKETS, rank_name: str = "rank") -> DataFrame:
    """Rows ranked <= k within each group (F-4 leaderboard).

    ``ties=False``: ``row_number`` (exactly k rows per group, ties broken by
    the tie-break keys). ``ties=True``: ``rank`` (all rows tied at the k-th
    place kept). Stage 1 ranks within ``(group, salt)``, where salt is a hash
    of the row; a row outside the top k of its bucket cannot be in the top k
    of its group, so stage 2 only sees at most ``k * salt_buckets`` rows per
    group.
    """
    group = list(group)
    order = _order(col, desc, tiebreak)
    fn = F.rank if ties else F.row_number
    if salt_buckets and salt_buckets > 1:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
        w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", salt)
              .withColumn("_r1", fn().over(w1))
              .filter(F.col("_r1") <= k)
              .drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_name, fn().over(w2)).filter(F.col(rank_name) <= k)


def latest_per_key(df: DataFrame, key: Sequence[str], ts: str, tiebreak: str | None = None) -> DataFrame:
    """Current state per key (F-9): the whole row with the greatest ``ts``
    (tie-break on ``tiebreak``). ``max_by`` is a hash aggregate with map-side
    partial aggregation, so a hot key never gathers in one task."""
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    order_key = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    agg = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order_key).alias("_row"))
    return agg.select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def daily_series(df: DataFrame, ts: str, value: str | None, key: Sequence[str] = (),
                 agg: str = "sum") -> DataFrame:
    """Per key and day: the aggregate of ``value`` (or the row count)."""
    day = F.to_date(F.col(ts)).alias("day")
    if value is None:
        a = F.count(F.lit(1)).cast("double")
    else:
        a = getattr(F, agg)(F.col(value)).cast("double")
    return df.groupBy(*key, day).agg(a.alias("value"))


def fill_calendar(series: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Add missing days (value 0) between each key's first and last day.

    The calendar is generated per key with ``sequence`` over its own range,
    so no global calendar is built on the driver.
    """
    key = list(key)
    bounds = series.groupBy(*key).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    cal = bounds.select(*key, F.explode(F.sequence("_lo", "_hi")).alias("day"))
    return (cal.join(series, key + ["day"], "left")
            .select(*key, "day", F.coalesce(F.col("value"), F.lit(0.0)).alias("value")))


def trend(df: DataFrame, ts: str, value: str | None, key: Sequence[str] = (),
          window_days: int = 30) -> DataFrame:
    """Daily value with trailing ``window_days`` total and the prior period's
    total, and the percent change between them (F-6)."""
    key = list(key)
    s = fill_calendar(daily_series(df, ts, value, key), key)
    d = F.unix_date("day")
    w = Window.partitionBy(*key).orderBy(d)
    cur = F.sum("value").over(w.rangeBetween(-(window_days - 1), 0))
    prior = F.sum("value").over(w.rangeBetween(-(2 * window_days - 1), -window_days))
    return (s.withColumn("current_period", cur)
            .withColumn("prior_period", prior)
            .withColumn("change_pct", F.try_divide(F.col("current_period") - F.col("prior_period"),
                                                   F.col("prior_period")) * 100))


def rolling_mean(df: DataFrame, key: Sequence[str], order: str, col: str, n: int,
                 name: str = "rolling_mean") -> DataFrame:
    """Mean of the current and previous n-1 rows per key (F-7)."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.avg(col).over(w))


def change_points(df: DataFrame, key: Sequence[str], order: str, col: str,
                  threshold: float) -> DataFrame:
    """Rows whose change from the previous row exceeds ``threshold`` in
    absolute value (F-10)."""
    w = Window.partitionBy(*key).orderBy(order)
    return (df.withColumn("previous", F.lag(col).over(w))
            .withColumn("change", F.col(col) - F.col("previous"))
            .withColumn("is_change", F.abs(F.col("change")) > threshold))


def anomaly_z(df: DataFrame, key: Sequence[str], order: str, col: str, n: int = 7,
              z: float = 3.0) -> DataFrame:
    """z-score against the trailing n rows excluding the current one (F-11)."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-n, -1)
    mean, sd = F.avg(col).over(w), F.stddev_samp(col).over(w)
    return (df.withColumn("trail_mean", mean).withColumn("trail_sd", sd)
            .withColumn("z", F.try_divide(F.col(col) - F.col("trail_mean"), F.col("trail_sd")))
            .withColumn("is_anomaly", F.coalesce(F.abs(F.col("z")) > z, F.lit(False))))


def forecast_baseline(series: DataFrame, key: Sequence[str], order: str, col: str,
                      season: int = 7, window: int = 4) -> DataFrame:
    """Baseline forecasts for each row from earlier rows only (F-12):
    seasonal naive (value ``season`` rows back) and moving average of the
    previous ``window`` rows, with their absolute errors (backtest)."""
    w = Window.partitionBy(*key).orderBy(order)
    naive = F.lag(col, season).over(w)
    ma = F.avg(col).over(w.rowsBetween(-window, -1))
    return (series.withColumn("seasonal_naive", naive).withColumn("moving_avg", ma)
            .withColumn("err_naive", F.abs(F.col(col) - F.col("seasonal_naive")))
            .withColumn("err_ma", F.abs(F.col(col) - F.col("moving_avg"))))


# Default forecast scenarios and their multipliers.
DEFAULT_SCENARIOS = (("low", 0.9), ("base", 1.0), ("high", 1.2))


def forecast_scenarios(forecasts: DataFrame, col: str, scenarios=DEFAULT_SCENARIOS,
                       name: str = "scenario_forecast") -> DataFrame:
    """Scenario factors on a forecast (F-12): every row is repeated once per
    scenario with the forecast scaled by the scenario's factor. The
    scenarios are a literal array expanded by ``inline`` (a bounded
    generator, no join)."""
    arr = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(float(f)).alias("factor")) for s, f in scenarios])
    return (forecasts.select("*", F.inline(arr))
            .withColumn(name, F.col(col) * F.col("factor")))


def backtest_summary(forecasts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean absolute error of each baseline per key."""
    return forecasts.groupBy(*key).agg(F.avg("err_naive").alias("mae_naive"),
                                       F.avg("err_ma").alias("mae_ma"),
                                       F.count("err_naive").alias("n_scored"))


# Smoothing weights tried by the rolling-origin backtest.
SMOOTHING_WEIGHTS = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)


def _series(df: DataFrame, key: Sequence[str], order: str, col: str) -> DataFrame:
    """One bounded series per key: its values in order (a daily series, never an event log)."""
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).cast("double").alias("x")))).alias("_s"))
    return rows.select(*key, F.transform("_s", lambda s: s["o"]).alias("_o"), F.transform("_s", lambda s: s["x"]).alias("_x"))


def smoothed(x: Column, alpha: Column, beta: Column | None = None) -> Column:
    """Level and trend after each value of an array, by exponential smoothing
    (Holt's form with ``beta``, else without a trend): an array of structs.

    level = alpha x + (1 - alpha)(level + trend); trend = beta (level - last level) + (1 - beta) trend."""
    state = "array<struct<level:double,trend:double>>"

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        if beta is None:
            level, trend = alpha * v + (F.lit(1.0) - alpha) * last["level"], F.lit(0.0)
        else:
            level = alpha * v + (F.lit(1.0) - alpha) * (last["level"] + last["trend"])
            trend = beta * (level - last["level"]) + (F.lit(1.0) - beta) * last["trend"]
        return F.concat(acc, F.array(F.struct(level.alias("level"), trend.alias("trend"))))

    first = F.array(F.struct(x[0].alias("level"), F.lit(0.0).alias("trend"))).cast(state)
    return F.when(F.size(x) > 0, F.aggregate(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), first, step))


def smoothing_backtest(df: DataFrame, key: Sequence[str], order: str, col: str, horizons: int = 7, min_train: int = 7,
                       weights: Sequence[float] = SMOOTHING_WEIGHTS, trend_weight: float | None = None) -> DataFrame:
    """Rolling-origin backtest of exponential smoothing (F-12): for every weight
    and horizon the mean absolute error over all origins that have at least
    ``min_train`` values behind them and the horizon before the end.

    Each series is folded once per weight; nothing but (key, weight) rows is shuffled after that."""
    s = _series(df, key, order, col).withColumn("alpha", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    beta = None if trend_weight is None else F.lit(float(trend_weight))
    s = s.withColumn("_f", smoothed(F.col("_x"), F.col("alpha"), beta)).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    last = F.size("_x") - F.col("horizon")
    origins = F.when(last >= min_train, F.sequence(F.lit(min_train), last)).otherwise(F.array().cast("array<int>"))
    errors = F.transform(origins, lambda o: F.abs(F.element_at("_x", (o + F.col("horizon")).cast("int"))
                                                  - (F.element_at("_f", o)["level"] + F.col("horizon") * F.element_at("_f", o)["trend"])))
    s = s.withColumn("_e", errors)
    total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
    return s.select(*key, "alpha", "horizon", F.size("_e").cast("long").alias("n_origins"), F.try_divide(total, F.size("_e")).alias("mae"))


def smoothing_forecast(df: DataFrame, key: Sequence[str], order: str, col: str, horizons: int = 7, min_train: int = 7,
                       weights: Sequence[float] = SMOOTHING_WEIGHTS) -> DataFrame:
    """The next ``horizons`` values of each series (F-12) with the weight whose one-step
    rolling-origin error is smallest (the smaller weight of equals; the first one
    where a series is too short to be tested)."""
    tested = smoothing_backtest(df, key, order, col, 1, min_train, weights)
    best = tested.groupBy(*key).agg(F.min_by("alpha", F.struct(F.coalesce("mae", F.lit(float("inf"))), "alpha")).alias("alpha"))
    s = _series(df, key, order, col).join(best, list(key))
    level = F.element_at(smoothed(F.col("_x"), F.col("alpha")), -1)["level"]
    return s.select(*key, "alpha", F.element_at("_o", -1).alias("last"), level.alias("forecast")) \
        .withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))

"""Data-quality and profiling operators (E-1 .. E-18, B-24 .. B-26).

All profiles are single aggregate passes (one ``agg`` with an expression per
column, then ``unpivot``), so their cost is one scan regardless of column
count. Row-level rules are plain ``filter``/``when`` expressions.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import epoch_micros, nan_to_null
from tessera.operators.stats import quartile_fences


def outliers_iqr(df: DataFrame, col: str, side: str = "upper", k: float = 1.5,
                 tiebreak: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """Rows beyond the Tukey fences, sorted by the value descending (E-4).

    ``side='upper'`` (the source's rule) keeps ``x > Q3 + k*IQR``; 'lower'
    keeps ``x < Q1 - k*IQR``; 'both' keeps either. Quartiles are one scalar
    subquery, pushed to the scan as a filter bound.
    """
    q1, q3, lo_f, hi_f = quartile_fences(df, col, k, method)
    # compare the bare column so the range predicate is pushed into the parquet scan;
    # NaN (which Spark orders above every number) is excluded separately
    x = F.col(col).cast("double")
    not_nan = ~F.isnan(x)
    cond = {"upper": (x > hi_f) & not_nan, "lower": x < lo_f,
            "both": ((x > hi_f) & not_nan) | (x < lo_f)}[side]
    return (df.filter(cond)
            .orderBy(F.col(col).desc_nulls_last(), *[F.col(t) for t in tiebreak]))


def _missing_expr(df: DataFrame, c: str):
    t = dict(df.dtypes)[c]
    col = F.col(c)
    if t in ("double", "float"):
        return col.isNull() | F.isnan(col)
    if t == "string":
        return col.isNull() | (F.trim(col) == "")
    return col.isNull()


def profile(df: DataFrame, exact_distinct: bool = False, anomaly_missing_share: float = 0.2) -> DataFrame:
    """Column profile (E-1): rows, missing (null, NaN or blank text), missing
    share, distinct count, uniqueness ratio, and an anomaly flag when the
    missing share exceeds ``anomaly_missing_share`` or a column is constant.
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        d = F.count_distinct(F.col(c)) if exact_distinct else F.approx_count_distinct(F.col(c))
        aggs += [F.count_if(_missing_expr(df, c)).alias(f"_m{i}"), d.alias(f"_d{i}")]
    wide = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             F.col(f"_m{i}").cast("long").alias("n_missing"),
                             F.col(f"_d{i}").cast("long").alias("n_distinct"))
                    for i, c in enumerate(cols)])
    p = wide.select(F.col("_n").alias("n_rows"), F.inline(arr))
    share = F.try_divide(F.col("n_missing"), F.col("n_rows"))
    uniq = F.try_divide(F.col("n_distinct"), F.col("n_rows") - F.col("n_missing"))
    return p.select("column_name", "n_rows", "n_missing", share.alias("missing_share"),
                    "n_distinct", uniq.alias("uniqueness"),
                    ((share > anomaly_missing_share) | (F.col("n_distinct") <= 1)).alias("anomaly"))


def infer_nature(df: DataFrame, cols: Sequence[str] | None = None, numeric_share: float = 0.95,
                 max_levels_share: float = 0.05) -> DataFrame:
    """Quantitative vs qualitative per column (E-2): share of non-missing
    values that parse as numbers, and distinct ratio; a numeric column with
    few levels relative to rows is called qualitative (a code)."""
    cols = list(cols or df.columns)
    aggs = []
    for i, c in enumerate(cols):
        s = F.col(c).cast("string")
        aggs += [F.count(s).alias(f"_nn{i}"),
                 F.count(s.try_cast("double")).alias(f"_num{i}"),
                 F.count_distinct(s).alias(f"_d{i}")]
    wide = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_nn{i}").alias("n_present"),
                             F.col(f"_num{i}").alias("n_numeric"), F.col(f"_d{i}").alias("n_distinct"))
                    for i, c in enumerate(cols)])
    p = wide.select(F.inline(arr))
    num_share = F.try_divide(F.col("n_numeric"), F.col("n_present"))
    lvl_share = F.try_divide(F.col("n_distinct"), F.col("n_present"))
    nature = (F.when(F.col("n_present") == 0, "empty")
              .when((num_share >= numeric_share) & (lvl_share > max_levels_share), "quantitative")
              .otherwise("qualitative"))
    return p.select("column_name", F.col("n_present").cast("long").alias("n_present"),
                    num_share.alias("numeric_share"), F.col("n_distinct").cast("long").alias("n_distinct"),
                    nature.alias("nature"))


def grain(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """For each candidate key set: rows, distinct key tuples, unique flag (E-3).

    One distinct count per candidate (exact); the smallest unique candidate
    is the grain (``is_grain``).
    """
    n = df.select(F.count(F.lit(1))).scalar()
    parts = []
    for i, cand in enumerate(candidates):
        d = (df.select(*cand).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
             .select(F.lit(i).alias("candidate"), F.lit(",".join(cand)).alias("key_columns"),
                     F.lit(len(cand)).alias("width"), n.alias("n_rows"), "n_distinct"))
        parts.append(d)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("is_unique", F.col("n_rows") == F.col("n_distinct"))
    w = Window.orderBy(F.col("is_unique").desc(), "width", "candidate")
    return out.withColumn("is_grain", (F.row_number().over(w) == 1) & F.col("is_unique"))


def quality_score(profile_df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Dataset score from a :func:`profile` (E-6): completeness (1 - mean
    missing share), and share of columns without anomaly, combined by
    weights (default equal); columns ranked by missing share (root causes)."""
    w = weights or {"completeness": 0.5, "clean_columns": 0.5}
    agg = profile_df.agg((1 - F.avg("missing_share")).alias("completeness"),
                         F.avg((~F.col("anomaly")).cast("double")).alias("clean_columns"),
                         F.max("missing_share").alias("worst_missing_share"))
    score = sum(F.col(k) * F.lit(v) for k, v in w.items()) / F.lit(sum(w.values()))
    return agg.withColumn("score", score * 100)


def remediation_plan(df: DataFrame, profile_df: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """What to do about each column (E-6): 'drop' over ``drop_share`` missing,
    'impute' if any is missing, 'review' if it is constant, else 'keep'; with
    the rows it touches and the row-level blast radius of the whole plan: rows
    with a missing value in any column."""
    any_missing = F.lit(False)
    for c in df.columns:
        any_missing = any_missing | _missing_expr(df, c)
    hit = df.select(F.count_if(any_missing)).scalar()
    action = (F.when(F.col("missing_share") > drop_share, "drop").when(F.col("n_missing") > 0, "impute")
              .when(F.col("anomaly"), "review").otherwise("keep"))
    return profile_df.select("column_name", action.alias("action"), F.col("n_missing").alias("affected_rows"), hit.alias("blast_radius_rows"))


def root_causes(profile_df: DataFrame) -> DataFrame:
    """Columns ranked by their share of missing values, with the rows they
    affect (E-6 root-cause ranking / blast radius). The profile has one row
    per column, so the ranking window is small."""
    w = Window.orderBy(F.desc("missing_share"), "column_name")
    return (profile_df.select("column_name", "missing_share", F.col("n_missing").alias("affected_rows"))
            .withColumn("cause_rank", F.row_number().over(w)))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence, keep: str = "first") -> DataFrame:
    """Keep one row per key, chosen by an explicit order (E-7).

    Implemented with ``max_by``/``min_by`` over a struct, a hash aggregate with
    partial aggregation: skew-safe, no window sort per key.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ord_struct = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    pick = F.min_by if keep == "first" else F.max_by
    agg = df.groupBy(*keys).agg(pick(F.struct(*rest), ord_struct).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def completeness_by(df: DataFrame, dims: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Missing share per column within each group of ``dims`` (E-8)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        aggs.append(F.avg(_missing_expr(df, c).cast("double")).alias(f"missing_{c}"))
    return df.groupBy(*dims).agg(*aggs)


def reconcile(df: DataFrame, official: DataFrame, keys: Sequence[str], value: str,
              official_value: str, tol: float = 0.01) -> DataFrame:
    """Totals against reference figures (E-10): only breaches are returned."""
    got = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    ref = official.select(*keys, F.col(official_value).alias("reference"))
    j = got.join(ref, list(keys), "full")
    # integer zero keeps decimal money decimal (a 0.0 literal would turn it into double)
    diff = F.coalesce(F.col("total"), F.lit(0)) - F.coalesce(F.col("reference"), F.lit(0))
    ok = F.abs(diff) <= F.lit(tol) * F.abs(F.coalesce(F.col("reference"), F.lit(0)))
    return j.withColumn("diff", diff).filter(~ok)


def week_on_week(df: DataFrame, ts: str, value: str, tol: float = 0.5,
                 key: Sequence[str] = ()) -> DataFrame:
    """Weekly totals with the change against the previous week; breach when
    the relative change is larger than ``tol`` (E-10, lag variant)."""
    key = list(key)
    wk = F.date_trunc("week", F.col(ts)).cast("date").alias("week")
    g = df.groupBy(*key, wk).agg(F.sum(value).alias("total"))
    w = Window.partitionBy(*key).orderBy("week")
    prev = F.lag("total").over(w)
    return (g.withColumn("previous", prev)
            .withColumn("rel_change", F.try_divide(F.col("total") - F.col("previous"), F.col("previous")))
            .withColumn("breach", F.coalesce(F.abs(F.col("rel_change")) > tol, F.lit(False))))


def timeliness(df: DataFrame, source: str, ts: str, reference_time, max_lag_days: float) -> DataFrame:
    """Latest record per source and its lag to a reference time (E-11)."""
    ref = F.lit(reference_time).cast("timestamp_ntz")
    g = df.groupBy(source).agg(F.max(ts).alias("latest"), F.count(F.lit(1)).alias("n_rows"))
    lag_days = (epoch_micros(ref) - epoch_micros(F.col("latest"))) / 86_400_000_000
    return g.withColumn("lag_days", lag_days).withColumn("stale", F.col("lag_days") > max_lag_days)


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two schemas (E-12). Schemas
    are metadata: both sides are tiny frames built on the driver."""
    spark = new.sparkSession
    a = spark.createDataFrame([(n, t) for n, t in old.dtypes], "column_name string, old_type string")
    b = spark.createDataFrame([(n, t) for n, t in new.dtypes], "column_name string, new_type string")
    j = a.join(b, "column_name", "full")
    return j.withColumn(
        "change",
        F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped").otherwise("same"))


def provenance(df: DataFrame, ts: str, excluded: DataFrame, key: str, imputed_cols: Sequence[str] = ()) -> DataFrame:
    """Last update, rows kept, units excluded and imputations applied (E-13)."""
    kept = df.join(excluded.select(F.col(key).alias("_x")), F.col(key) == F.col("_x"), "left_anti")
    return kept.agg(F.max(ts).alias("last_update"), F.count(F.lit(1)).alias("rows_kept"),
                    excluded.select(F.count(F.lit(1))).scalar().alias("units_excluded"),
                    F.lit(",".join(imputed_cols)).alias("imputed_columns"))


def harmonise(tables: dict[str, DataFrame], mapping: dict[str, dict[str, tuple[str, str]]]) -> DataFrame:
    """Rename and cast each source to one schema and stack them with a
    ``source`` tag (E-18). ``mapping[source][target] = (source_col, type)``."""
    out = None
    for name, df in tables.items():
        m = mapping[name]
        sel = df.select(F.lit(name).alias("source"),
                        *[F.col(src).cast(typ).alias(tgt) for tgt, (src, typ) in m.items()])
        out = sel if out is None else out.unionByName(sel, allowMissingColumns=True)
    return out


def cap_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Clamp each column into its Tukey fences (B-24); fences are scalar
    subqueries, so the clamp is a projection."""
    out = df
    for c in cols:
        _, _, lo, hi = quartile_fences(df, c, k)
        out = out.withColumn(c, F.least(F.greatest(F.col(c).cast("double"), lo), hi))
    return out


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean", value=None) -> DataFrame:
    """Missing-value treatment (B-26): drop | mean | median | mode | constant.

    Statistics are scalar subqueries over the column itself.
    """
    if strategy == "drop":
        return df.dropna(subset=list(cols))
    out = df
    for c in cols:
        x = nan_to_null(F.col(c).cast("double")) if strategy in ("mean", "median") else F.col(c)
        if strategy == "mean":
            fill = df.select(F.avg(x)).scalar()
        elif strategy == "median":
            from tessera.operators.stats import global_quantiles
            (fill,) = global_quantiles(df, c, [0.5])
        elif strategy == "mode":
            fill = df.select(F.mode(F.col(c))).scalar()
        elif strategy == "constant":
            fill = F.lit(value)
        else:
            raise ValueError(strategy)
        out = out.withColumn(c, F.coalesce(x, fill))
    return out


def quality_gate(checks) -> DataFrame:
    """Release checklist (E-14): ``checks`` is a list of
    ``(name, one_row_metric_frame, max_ok)``; each frame has one column
    ``metric``. Result rows ``(check_name, metric, passed)``."""
    out = None
    for name, frame, max_ok in checks:
        row = frame.select(F.lit(name).alias("check_name"), F.col("metric").cast("double").alias("metric"),
                           (F.col("metric") <= F.lit(max_ok)).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def log_gate(results: DataFrame, path: str, run_ts: str) -> None:
    """Append a gate run to its log (E-14): the results stamped with the run
    time (a literal parameter) and written partitioned by run date, so a
    history query reads only the days it asks for."""
    ts = F.lit(run_ts).cast("timestamp_ntz")
    (results.withColumn("run_ts", ts).withColumn("run_date", F.to_date(ts))
     .write.mode("append").partitionBy("run_date").parquet(path))


def readiness_scan(df: DataFrame, ts: str, value: str, min_periods: int = 28, min_volume: int = 20,
                   max_missing: float = 0.05, max_drift_cv: float = 0.25) -> DataFrame:
    """Descriptive-or-predictive advice (E-17) from per-day volume, missing
    share and drift (coefficient of variation of the daily mean)."""
    d = df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(value).isNull().cast("double")).alias("miss"),
        F.avg(value).alias("mean"))
    s = d.agg(F.count(F.lit(1)).alias("periods"), F.min("n").alias("min_volume"),
              F.max("miss").alias("max_missing"),
              F.try_divide(F.stddev_samp("mean"), F.avg("mean")).alias("drift_cv"))
    ok = ((F.col("periods") >= min_periods) & (F.col("min_volume") >= min_volume)
          & (F.col("max_missing") <= max_missing) & (F.col("drift_cv") <= max_drift_cv))
    return s.withColumn("advice", F.when(ok, "predictive").otherwise("descriptive"))


def prompt_audit(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """Prompt-log audit (E-16): user prompts, how many got an output (the
    next turn is the assistant's), how many ran under a template (a system
    turn earlier in the conversation), decision-facing prompts (questions)
    and those left without output. Next-turn and earlier-system look-ups
    are bucketed by blocks of 1000 turns (skew-safe)."""
    from tessera.operators import windows as WB
    bucket = F.floor(F.col(turn) / F.lit(1000))
    c = conv.withColumn("_sys", (F.col(role) == "system").cast("int"))
    c = WB.shift_many(c, [conv_id], [turn], bucket, [(turn, "_nxt_turn", "lead"), (role, "_nxt_role", "lead")])
    c = WB.running(c, [conv_id], [turn], "_sys", bucket, "_sys_before", "max", exclusive=True)
    nxt_turn, nxt_role, sys_before = F.col("_nxt_turn"), F.col("_nxt_role"), F.col("_sys_before")
    u = (c.withColumn("has_output", F.coalesce((nxt_turn == F.col(turn) + 1) & (nxt_role == "assistant"), F.lit(False)))
         .withColumn("has_template", F.coalesce(sys_before == 1, F.lit(False)))
         .filter(F.col(role) == "user"))
    q = F.col(text).contains("?")
    return u.agg(F.count(F.lit(1)).alias("n_prompts"), F.count_if("has_output").alias("n_with_output"),
                 F.count_if("has_template").alias("n_with_template"),
                 F.count_if(q).alias("n_decision_facing"),
                 F.count_if(q & ~F.col("has_output")).alias("n_unreviewed_decisions"))


#: Relative standard deviation of the distinct sketches of ``find_grain``; a key's estimate
#: lies within five of them of the row count.
GRAIN_RSD = 0.02


def find_grain(df: DataFrame, columns: Sequence[str] | None = None, max_width: int = 3, per_pass: int = 40) -> DataFrame:
    """All minimal keys of up to ``max_width`` columns, without given candidates (E-3).

    The lattice of column sets is searched level by level: no set that holds a key found
    before is looked at, none whose distinct counts can't multiply to the row
    count (they are upper bounds of that of the set), and none whose distinct sketch is
    far below it. Sketches of a level share scans, ``per_pass`` to one; what is
    left is confirmed exactly, by looking for a repeated tuple. Nulls count as a value.

    Returns ``(key_columns, width, n_rows, n_sketched, n_confirmed)``: each key and, for its
    level, how many sets were sketched and how many confirmed or refuted exactly."""
    spark = df.sparkSession
    columns = list(columns or df.columns)
    schema = "key_columns string, width int, n_rows long, n_sketched long, n_confirmed long"
    n = df.count()
    found: list[tuple[int, ...]] = []
    out: list[tuple] = []
    distinct: dict[tuple[int, ...], float] = {}
    least = n * (1 - 5 * GRAIN_RSD)
    for width in range(1, max_width + 1):
        level = [c for c in itertools.combinations(range(len(columns)), width) if not any(set(k) <= set(c) for k in found)]
        level = [c for c in level if _can_be_key(c, distinct, n)]
        for at in range(0, len(level), per_pass):
            part = level[at : at + per_pass]
            aggs = [F.approx_count_distinct(F.xxhash64(*[F.struct(F.col(columns[i])) for i in c], *[F.col(columns[i]).isNull() for i in c]), GRAIN_RSD).alias(f"_{j}")
                    for j, c in enumerate(part)]
            distinct.update(zip(part, df.agg(*aggs).first()))
        likely = [c for c in level if distinct[c] >= least]
        keys = []
        for c in likely:
            names = [columns[i] for i in c]
            if df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
                keys.append(c)
        found += keys
        out += [(",".join(columns[i] for i in c), width, n, len(level), len(likely)) for c in keys]
    return spark.createDataFrame(out, schema)


def _can_be_key(c: tuple[int, ...], distinct: dict[tuple[int, ...], float], n: int) -> bool:
    """Whether the distinct counts of a set's parts can multiply to n; estimates count with five deviations more."""
    if len(c) == 1:
        return True
    bound = 1.0
    for i in c:
        bound *= distinct[(i,)] * (1 + 5 * GRAIN_RSD) + 1
    return bound >= n


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact ``(column_name, n_distinct)`` of all columns by one aggregate over (column,
    value) pairs: repeats fold on the map side, no column multiplies the others' rows. Nulls don't count."""
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    pairs = df.select(F.inline(values)).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.lit(1).alias("_one"))
    counts = pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(counts, "column_name", "left").select("column_name", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


class ProfileStore:
    """A column profile kept as one set of mergeable sketches per day (E-1): a run reads
    only its day, and the profile of any span is the union of its days.

    Files lie at ``path/day=<day>``; writing a day again replaces it."""

    def __init__(self, spark: SparkSession, path: str, lg_k: int = 14):
        self.spark, self.path, self.lg_k = spark, path.rstrip("/"), lg_k

    def put(self, df: DataFrame, day: Column | str) -> None:
        """Sketches every day in ``df``, in one scan. ``day`` is a date column or expression."""
        d = F.col(day) if isinstance(day, str) else day
        cols = [c for c in df.columns if c != day]
        aggs = [F.count(F.lit(1)).alias("_n")]
        for i, c in enumerate(cols):
            aggs += [F.count_if(_missing_expr(df, c)).alias(f"_m{i}"), F.hll_sketch_agg(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(self.lg_k)).alias(f"_h{i}")]  # a sketch skips empty text
        wide = df.groupBy(d.cast("date").alias("day")).agg(*aggs)
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("n_missing"), F.col(f"_h{i}").alias("sketch")) for i, c in enumerate(cols)])
        out = wide.select("day", F.col("_n").alias("n_rows"), F.inline(rows))
        (out.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path))

    def profile(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """``(column_name, n_rows, n_missing, n_distinct)`` over the stored days from ``first`` to ``last``;
        the distinct count is an estimate."""
        days = self.spark.read.schema("n_rows long, column_name string, n_missing long, sketch binary, day date").parquet(self.path)
        if first is not None:
            days = days.where(F.col("day") >= F.lit(first).cast("date"))
        if last is not None:
            days = days.where(F.col("day") <= F.lit(last).cast("date"))
        g = days.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), F.hll_union_agg("sketch").alias("_s"))
        return g.select("column_name", "n_rows", "n_missing", F.hll_sketch_estimate("_s").alias("n_distinct"))

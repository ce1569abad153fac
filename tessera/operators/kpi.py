"""KPI measures over a star schema and report building blocks
(B-20 .. B-22, C-6, D-9 .. D-19, D-33, D-34, L-1 .. L-3).

The reference names these measures but its definitions are not public; every
definition below is a choice of this project and documented in the docstring.
Facts at a finer grain than the interaction are aggregated to the
interaction *before* joining, so joining several facts never multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import epoch_micros, rag_status


def calc_columns(df: DataFrame, start_ts: str, end_ts: str, s_start: str, s_end: str,
                 ai_flag: Column) -> DataFrame:
    """Calculated interaction columns (B-20): ``was_ai_handled``,
    ``sentiment_delta`` (null when either side is missing) and
    ``resolution_minutes``."""
    minutes = (epoch_micros(end_ts) - epoch_micros(start_ts)) / F.lit(60_000_000)
    return (df.withColumn("was_ai_handled", ai_flag)
            .withColumn("sentiment_delta", F.col(s_end) - F.col(s_start))
            .withColumn("resolution_minutes", minutes))


def slice_by(df: DataFrame, **filters) -> DataFrame:
    """Conjunctive slicers (B-22): ``col=value``, ``col=[values]`` or
    ``col=(low, high)`` (inclusive). Plain filters, so they reach the scan."""
    out = df
    for col, v in filters.items():
        c = F.col(col)
        if isinstance(v, tuple) and len(v) == 2:
            lo, hi = v
            if lo is not None:
                out = out.filter(c >= F.lit(lo))
            if hi is not None:
                out = out.filter(c <= F.lit(hi))
        elif isinstance(v, (list, set, frozenset)):
            out = out.filter(c.isin(list(v)))
        else:
            out = out.filter(c == F.lit(v))
    return out


def kpi_volume(star: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, AI, human interactions and AI penetration (D-10)."""
    return star.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("was_ai_handled").alias("ai"),
        F.count_if(~F.col("was_ai_handled")).alias("human"),
    ).withColumn("ai_penetration", F.col("ai") / F.col("total"))


def kpi_quality(star: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average QA scores and sentiment improvement (D-11)."""
    return star.groupBy(*by).agg(
        F.avg("qa_human").alias("avg_qa_human"), F.avg("qa_ai").alias("avg_qa_ai"),
        F.avg("sentiment_delta").alias("avg_sentiment_delta"),
        F.avg((F.col("sentiment_delta") > 0).cast("double")).alias("improved_share"))


def kpi_efficiency(star: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Escalation rate, 7-day repeat contact rate, mean resolution time and
    first-contact resolution (resolved and not followed by a repeat) (D-12).
    ``star`` needs ``is_repeat`` and ``next_is_repeat`` (see
    :func:`repeat_flags`)."""
    fcr = F.col("resolved") & ~F.col("next_is_repeat")
    return star.groupBy(*by).agg(
        F.avg(F.col("escalated").cast("double")).alias("escalation_rate"),
        F.avg(F.col("is_repeat").cast("double")).alias("repeat_rate"),
        F.avg("resolution_minutes").alias("avg_resolution_minutes"),
        F.avg(fcr.cast("double")).alias("fcr"))


def repeat_flags(df: DataFrame, customer: str, ts: str, tiebreak: str, days: int = 7,
                 bucket: Column | None = None) -> DataFrame:
    """``is_repeat`` (an earlier contact within ``days``) and
    ``next_is_repeat`` (the next contact comes within ``days``).

    Previous/next contact per customer come from bucketed windows (default
    bucket: the day of the contact), so a customer with a third of all
    contacts is still split over many tasks."""
    from tessera.operators import windows as WB
    b = bucket if bucket is not None else F.date_trunc("day", F.col(ts))
    d = df.withColumn("_tus", epoch_micros(ts))
    d = WB.shift_many(d, [customer], [ts, tiebreak], b, [("_tus", "_prev", "lag"), ("_tus", "_next", "lead")])
    day = F.lit(86_400_000_000)
    return (d.withColumn("is_repeat", F.coalesce((F.col("_tus") - F.col("_prev")) / day <= days, F.lit(False)))
            .withColumn("next_is_repeat", F.coalesce((F.col("_next") - F.col("_tus")) / day <= days, F.lit(False)))
            .drop("_tus", "_prev", "_next"))


def kpi_compliance(star: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Compliance events, critical failures, frustration index (D-13)."""
    return star.groupBy(*by).agg(
        F.sum("compliance_events").alias("compliance_events"),
        F.sum("critical_failures").alias("critical_failures"),
        F.avg("frustration").alias("frustration_index"))


def kpi_headline(star: DataFrame, weights: dict[str, Sequence[float]] | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Quality, Efficiency and Compliance indices on a 0..100 scale and the
    overall CX score as their mean (D-9). Component weights default to
    equal.

    quality    = human QA, AI QA, sentiment score (end sentiment x 100), safety
    efficiency = containment (AI-handled and resolved share), no-escalation
                 share, first-contact resolution
    compliance = compliance rate (lines without compliance events), no
                 critical failure share, 100 - frustration
    """
    w = {"quality": (1, 1, 1, 1), "efficiency": (1, 1, 1), "compliance": (1, 1, 1)}
    w.update(weights or {})
    fcr = F.col("resolved") & ~F.col("next_is_repeat")
    g = star.groupBy(*by).agg(
        F.avg("qa_human").alias("_q1"), F.avg("qa_ai").alias("_q2"),
        F.avg(F.col("sentiment_end") * 100).alias("_q3"), F.avg("safety").alias("_q4"),
        F.avg((F.col("was_ai_handled") & F.col("resolved")).cast("double") * 100).alias("_e1"),
        F.avg((~F.col("escalated")).cast("double") * 100).alias("_e2"),
        F.avg(fcr.cast("double") * 100).alias("_e3"),
        (100 - F.try_divide(F.sum("compliance_events"), F.sum("n_lines")) * 100).alias("_c1"),
        F.avg((F.col("critical_failures") == 0).cast("double") * 100).alias("_c2"),
        (100 - F.avg("frustration") * 100).alias("_c3"))

    def wmean(prefix, ws):
        num = sum(F.col(f"_{prefix}{i + 1}") * F.lit(float(x)) for i, x in enumerate(ws))
        return num / F.lit(float(sum(ws)))

    q, e, c = wmean("q", w["quality"]), wmean("e", w["efficiency"]), wmean("c", w["compliance"])
    return g.select(*by, q.alias("quality_index"), e.alias("efficiency_index"), c.alias("compliance_health")) \
        .withColumn("overall_cx", (F.col("quality_index") + F.col("efficiency_index") + F.col("compliance_health")) / 3)


def kpi_vs_target(kpis_long: DataFrame, targets: DataFrame, amber_share: float = 0.95) -> DataFrame:
    """Current vs target, direction aware (D-14). ``kpis_long``:
    ``(kpi, value)``; ``targets``: ``(kpi, target, direction)`` with
    direction '>' (higher is better) or '<'. Status via RAG: green when the
    target is met, amber within ``amber_share`` of it, else red."""
    j = kpis_long.join(targets, "kpi", "left")
    higher = F.col("direction") == ">"
    gap = F.when(higher, F.col("value") - F.col("target")).otherwise(F.col("target") - F.col("value"))
    met = gap >= 0
    near = F.when(higher, F.col("value") >= F.col("target") * amber_share) \
        .otherwise(F.col("value") <= F.col("target") / amber_share)
    status = F.when(F.col("value").isNull() | F.col("target").isNull(), "Grey") \
        .when(met, "Green").when(near, "Amber").otherwise("Red")
    return j.withColumn("gap", gap).withColumn("status", status)


def kpi_hierarchy(leaf_values: DataFrame, links: DataFrame, levels: int = 4) -> DataFrame:
    """Roll values up a bounded hierarchy (D-15): ``leaf_values(node,
    value)`` and ``links(child, parent)``. Each level is one join of the
    previous level's totals to the links and a group-by on the parent, so
    at most ``levels`` joins run regardless of size. Output ``(node, level,
    value)``; level 1 = leaves."""
    cur = leaf_values.select(F.col("node"), F.col("value")).withColumn("level", F.lit(1))
    out = cur
    for lvl in range(2, levels + 1):
        up = (cur.join(links, cur.node == links.child)
              .groupBy(F.col("parent").alias("node")).agg(F.sum("value").alias("value"))
              .withColumn("level", F.lit(lvl)))
        out = out.unionByName(up)
        cur = up
    return out


def compare_groups(df: DataFrame, dims: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    """Group comparison table (D-16): ``metrics`` maps names to aggregate
    expressions."""
    return df.groupBy(*dims).agg(*[e.alias(n) for n, e in metrics.items()])


def driver_share(df: DataFrame, group: Sequence[str], driver: str, weight: str | None = None) -> DataFrame:
    """Share of each driver within its group (D-17): grouped totals first,
    then a window sum over the (small) grouped result."""
    val = F.count(F.lit(1)) if weight is None else F.sum(weight)
    g = df.groupBy(*group, driver).agg(val.alias("n"))
    w = Window.partitionBy(*group)
    return g.withColumn("share", F.col("n") / F.sum("n").over(w))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Label distribution with shares (D-19)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return g.withColumn("share", F.col("n") / total)


def breakdown(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts and share of the total per combination of dims (D-33)."""
    return class_balance(df.select(*dims).withColumn("_k", F.struct(*dims)), "_k") \
        .select(*[F.col("_k")[d].alias(d) for d in dims], "n", "share")


def market_metrics(df: DataFrame, group: str, qty: str, price: str, margin: Column) -> DataFrame:
    """Per group: volume, coefficient of variation of quantity (yield
    variability), mean and CV of unit price (price dynamics), mean margin
    ratio (D-34)."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(qty).alias("mean_qty"), F.try_divide(F.stddev_samp(qty), F.avg(qty)).alias("cv_qty"),
        F.avg(price).alias("mean_price"), F.try_divide(F.stddev_samp(price), F.avg(price)).alias("cv_price"),
        F.avg(margin).alias("margin_ratio"))


def group_fairness(preds: DataFrame, group: str, pred: str, label: str | None = None) -> DataFrame:
    """Positive-prediction rate (and true-positive rate when labels are
    given) per group plus the max-min gap over groups (D-30)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.col(pred).cast("double")).alias("positive_rate")]
    if label:
        aggs.append(F.try_divide(F.count_if((F.col(pred) == 1) & (F.col(label) == 1)),
                                 F.count_if(F.col(label) == 1)).alias("tpr"))
    g = preds.groupBy(group).agg(*aggs)
    gap = g.select((F.max("positive_rate") - F.min("positive_rate"))).scalar()
    return g.withColumn("parity_gap", gap)


def insight_text(deltas: DataFrame, metric: str, change: str, period_days: int, driver: str | None = None) -> DataFrame:
    """One templated sentence per row (L-1): metric, signed change in
    percent (one decimal), period, and the driver when given."""
    sign = F.when(F.col(change) >= 0, F.lit("+")).otherwise(F.lit(""))
    parts = [F.col(metric), F.lit(" changed by "), sign, F.round(F.col(change), 1).cast("string"),
             F.lit(f"% over the last {period_days} days")]
    if driver:
        parts += [F.lit(" (main driver: "), F.col(driver), F.lit(")")]
    return deltas.withColumn("insight", F.concat(*parts, F.lit(".")))


def weekly_story(insights: DataFrame, score: str, text: str, k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """The k largest movements joined into one paragraph (L-2). Top-k per
    group first (two-stage), so the list that is built has at most k items."""
    from tessera.operators.ranking import top_k_per_group
    top = top_k_per_group(insights.withColumn("_s", F.abs(F.col(score))), list(by), "_s", k,
                          tiebreak=[text], rank_name="_r")
    return top.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", text))), lambda x: x[text]), " ")
        .alias("story"), F.count(F.lit(1)).alias("n_items"))


def drill_through(detail: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Diagnostic rows behind a KPI (L-3): detail rows whose parent keys are
    in ``parents`` (left semi join)."""
    return detail.join(parents.select(*keys).distinct(), list(keys), "left_semi")


def rag(df: DataFrame, col: str, amber: float, green: float, higher_is_better: bool = True,
        name: str = "rag") -> DataFrame:
    """Traffic-light column (B-21)."""
    return df.withColumn(name, rag_status(F.col(col), amber, green, higher_is_better))

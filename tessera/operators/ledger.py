"""Entity lifecycle, stock ledgers and CRM (G-4 .. G-14, D-20, D-21, D-32,
F-13, B-23, B-28, C-4, C-10).

Ledgers are append-only: current stock is an aggregate over signed moves,
never a mutable row. Running balances are computed per (item, period)
bucket plus a per-item offset, so one very busy item is spread over many
tasks instead of one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tasks import haystack


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count (G-4)."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def stamp_created(df: DataFrame, batch_ts: str, name: str = "created_at") -> DataFrame:
    """Stamp rows with the batch time (G-5): a literal parameter, so reruns
    give the same result."""
    return df.withColumn(name, F.lit(batch_ts).cast("timestamp_ntz"))


def stock_position(moves: DataFrame, item: str = "item", qty: str = "qty") -> DataFrame:
    """Stock per item = signed sum of moves; sold out when <= 0 (G-6)."""
    return (moves.groupBy(item).agg(F.sum(qty).alias("stock"),
                                   F.sum(F.when(F.col(qty) > 0, F.col(qty)).otherwise(0)).alias("stock_in"),
                                   F.sum(F.when(F.col(qty) < 0, -F.col(qty)).otherwise(0)).alias("stock_out"))
            .withColumn("sold_out", F.col("stock") <= 0))


def stock_history(moves: DataFrame, item: str = "item", ts: str = "ts", tiebreak: str = "move_id",
                  qty: str = "qty", period: str = "day") -> DataFrame:
    """Every move with the running balance of its item (G-7).

    Two steps, both exact:
    1. totals per (item, period) and their running sum per item: the
       balance at the start of each period (a window over periods, which
       are few per item);
    2. a running sum inside each (item, period) bucket, plus that offset.
    """
    bucket = F.date_trunc(period, F.col(ts)).alias("_bucket")
    m = moves.withColumn("_bucket", bucket)
    totals = m.groupBy(item, "_bucket").agg(F.sum(qty).alias("_t"))
    wp = Window.partitionBy(item).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_t").over(wp), F.lit(0.0))).drop("_t")
    # the quantity is the last tie-break: rows equal on all order keys are
    # then identical, so every order of them gives the same multiset of rows
    tb = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    wr = (Window.partitionBy(item, "_bucket").orderBy(ts, *tb, qty)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    from tessera.operators.windows import null_safe_join
    return (null_safe_join(m, offsets, [item, "_bucket"])
            .withColumn("balance", F.col("_offset") + F.sum(qty).over(wr))
            .drop("_bucket", "_offset"))


def receipt(lines: DataFrame, sale: str, qty: str, price: str, discount: str | None = None) -> DataFrame:
    """Receipt lines with line totals and the grand total of the sale (G-8).

    Long form (one row per line): the grand total comes from a grouped sum
    joined back, never from a per-sale list.
    """
    line_total = F.col(qty) * F.col(price)
    if discount:
        line_total = line_total * (1 - F.col(discount))
    l2 = lines.withColumn("line_total", line_total)
    totals = l2.groupBy(sale).agg(F.sum("line_total").alias("grand_total"),
                                  F.count(F.lit(1)).alias("n_lines"))
    from tessera.operators.windows import null_safe_join
    return null_safe_join(l2, totals, [sale])


def order_lifecycle(events: DataFrame, allowed: DataFrame, key: str, ts: str, status: str,
                    tiebreak: str) -> DataFrame:
    """Each status change with its previous status and whether the
    transition is allowed (G-9). ``allowed`` has columns ``from_status,
    to_status``; first events have no previous status and are legal. The
    previous status per key comes from an hour-bucketed shift (skew-safe)."""
    from tessera.operators import windows as WB
    t = WB.shift(events, [key], [ts, tiebreak], status, F.date_trunc("hour", F.col(ts)), "from_status", "lag")
    t = t.withColumnRenamed(status, "to_status")
    a = allowed.select("from_status", "to_status").distinct().withColumn("_ok", F.lit(True))
    j = t.join(a, ["from_status", "to_status"], "left")
    return j.withColumn("legal", F.col("from_status").isNull() | F.coalesce(F.col("_ok"), F.lit(False))).drop("_ok")


def payment_status(due: Column, first_use: Column, amount: Column, tol: float) -> Column:
    """Status of one piece of payment evidence (G-10)."""
    return (F.when(due.isNull(), "unknown_order").when(~first_use, "duplicate")
            .when(F.abs(amount - due) > F.lit(tol) * F.abs(due), "amount_mismatch").otherwise("matched"))


def payment_match(evidence: DataFrame, orders: DataFrame, ref: str, amount: str, order_key: str,
                  order_amount: str, tol: float = 0.01) -> DataFrame:
    """Payment evidence against orders (G-10): status per evidence row is
    'unknown_order', 'duplicate' (the reference was already used by earlier
    evidence), 'amount_mismatch' or 'matched'. Evidence needs an ``evidence_id``."""
    uses = evidence.groupBy(ref).agg(F.min("evidence_id").alias("_first"))
    o = orders.select(F.col(order_key).alias(ref), F.col(order_amount).alias("_due"))
    # evidence without a reference belongs to no order and stays, as 'unknown_order'
    j = evidence.join(uses, ref, "left").join(o, ref, "left")
    status = payment_status(F.col("_due"), F.col("evidence_id") == F.col("_first"), F.col(amount), tol)
    return j.withColumn("status", status).withColumnRenamed("_due", "order_amount").drop("_first")


def rfm_scores(orders: DataFrame, customer: str, ts: str, amount: str, ref_time: str,
               bins: int = 5, method: str = "exact") -> DataFrame:
    """Recency / frequency / monetary per customer and 1..bins scores from
    global cut points (G-11). The cut points of all three measures come from one
    quantile plan over (measure, value) rows and are one scalar subquery, so scoring is a
    projection, not a global sort."""
    ref = F.lit(ref_time).cast("timestamp_ntz")
    g = orders.groupBy(customer).agg(
        F.datediff(ref, F.max(ts)).alias("recency_days"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum(amount).alias("monetary"))
    from tessera.operators.stats import columns_quantiles
    cuts = columns_quantiles(g, ("recency_days", "frequency", "monetary"), [i / bins for i in range(1, bins)], method)

    def score(col, arr, higher_better=True):
        above = sum((F.col(col) > arr[i]).cast("int") for i in range(bins - 1))
        return (above + 1) if higher_better else (F.lit(bins) - above)

    return (g.withColumn("r_score", score("recency_days", cuts["recency_days"], higher_better=False))
            .withColumn("f_score", score("frequency", cuts["frequency"]))
            .withColumn("m_score", score("monetary", cuts["monetary"]))
            .withColumn("segment", F.when((F.col("r_score") >= 4) & (F.col("f_score") >= 4), "champion")
                        .when(F.col("r_score") <= 2, "at risk").otherwise("regular")))


def audit_trail(log: DataFrame, entity_col: str, entity, ts: str, tiebreak: str) -> DataFrame:
    """History of one entity from an append-only log (G-12). The log is
    meant to be stored partitioned by date; the entity filter is pushed to
    the scan."""
    return log.filter(F.col(entity_col) == F.lit(entity)).orderBy(ts, tiebreak)


def write_audit(log: DataFrame, path: str, ts: str) -> None:
    log.withColumn("log_date", F.to_date(ts)).write.mode("append").partitionBy("log_date").parquet(path)


def handoff_state(msgs: DataFrame, conv: str, order: str, control: F.Column, paused: F.Column) -> DataFrame:
    """For each message: the last control event before it and whether the
    assistant is paused (G-13). ``control`` marks control rows, ``paused``
    tells whether a control row pauses (else it resumes). The look-back is
    bucketed by blocks of ``order`` (skew-safe for a huge conversation)."""
    from tessera.operators import windows as WB
    bucket = F.floor(F.col(order) / F.lit(1000))
    m = msgs.withColumn("_ctl", F.when(control, F.col(order))) \
            .withColumn("_pause", F.when(control, paused))
    m = WB.last_non_null(m, [conv], [order], "_ctl", bucket, "last_control")
    m = WB.last_non_null(m, [conv], [order], "_pause", bucket, "_last_pause")
    return (m.withColumn("ai_paused", F.coalesce(F.col("_last_pause"), F.lit(False)))
            .drop("_ctl", "_pause", "_last_pause"))


def feedback_tracking(items: DataFrame, group: str, opened: str, is_closed: F.Column, ref_time: str) -> DataFrame:
    """Open/closed counts, mean age of the open items and closure rate per
    group (G-14)."""
    ref = F.lit(ref_time).cast("timestamp_ntz")
    age = F.datediff(ref, F.col(opened))
    return items.groupBy(group).agg(
        F.count_if(~is_closed).alias("n_open"), F.count_if(is_closed).alias("n_closed"),
        F.avg(F.when(~is_closed, age)).alias("mean_open_age_days"),
        F.avg(is_closed.cast("double")).alias("closure_rate"))


def store_kpis(position: DataFrame, reorder: DataFrame, item: str, sales: DataFrame, revenue: str,
               orders: DataFrame, open_flag: F.Column) -> DataFrame:
    """Low stock, sold out, stock in/out, total sales, open orders (D-20):
    one row built from three aggregates."""
    p = position.join(reorder, item, "left")
    a = p.agg(F.count_if(F.col("stock") <= F.col("reorder_level")).alias("low_stock"),
              F.count_if(F.col("sold_out")).alias("sold_out"),
              F.sum("stock_in").alias("stock_in"), F.sum("stock_out").alias("stock_out"))
    return a.select("*", sales.select(F.sum(revenue)).scalar().alias("total_sales"),
                    orders.select(F.count_if(open_flag)).scalar().alias("open_orders"))


def reorder_alerts(position: DataFrame, reorder: DataFrame, item: str) -> DataFrame:
    """Items at or below their reorder level, with the risk ratio
    stock/reorder level (D-21)."""
    p = position.join(reorder, item)
    return (p.filter(F.col("stock") <= F.col("reorder_level"))
            .withColumn("risk_ratio", F.try_divide(F.col("stock"), F.col("reorder_level"))))


def leakage(expected: DataFrame, recorded: DataFrame, key: str, value: str, tol: float) -> DataFrame:
    """Expected vs recorded totals per key (D-32): full outer join of two
    pre-aggregated sides; rows whose gap exceeds ``tol`` (absolute)."""
    e = expected.groupBy(key).agg(F.sum(value).alias("expected"))
    r = recorded.groupBy(key).agg(F.sum(value).alias("recorded"))
    j = e.join(r, key, "full")
    gap = F.coalesce(F.col("expected"), F.lit(0)) - F.coalesce(F.col("recorded"), F.lit(0))
    return j.withColumn("gap", gap).filter(F.abs(F.col("gap")) > tol)


def stock_cover(position: DataFrame, moves: DataFrame, item: str, ts: str, qty: str,
                as_of: str, days: int = 30) -> DataFrame:
    """Days of cover (F-13): stock / mean daily outflow over the last
    ``days`` days before ``as_of``; null when there was no outflow."""
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = moves.filter((F.col(ts) < end) & (F.col(ts) >= end - F.make_dt_interval(F.lit(days)))
                          & (F.col(qty) < 0))
    out = recent.groupBy(item).agg((F.sum(-F.col(qty)) / F.lit(days)).alias("daily_out"))
    return (position.join(out, item, "left")
            .withColumn("days_of_cover", F.try_divide(F.col("stock"), F.col("daily_out"))))


def scope_rows(df: DataFrame, grants: DataFrame, key: str, grant_key: str | None = None) -> DataFrame:
    """Row-level scoping (B-23): rows whose tenant key is granted, via a
    left semi join (never multiplies rows; a small grants table is broadcast
    by AQE when measured small)."""
    gk = grant_key or key
    return df.join(grants.select(F.col(gk).alias("_g")).distinct(), F.col(key) == F.col("_g"), "left_semi")


def catalog_search(sources: dict[str, tuple[DataFrame, str, Sequence[str]]], needle: str) -> DataFrame:
    """Search several tables at once (B-28): ``sources[name] = (df, id_col,
    text_cols)``; matches are stacked as ``(entity, entity_id, label)``."""
    n = needle.strip().lower()
    out = None
    for name, (df, id_col, cols) in sources.items():
        hit = df.filter(haystack(cols).contains(F.lit(n))) if n else df
        part = hit.select(F.lit(name).alias("entity"), F.col(id_col).cast("string").alias("entity_id"),
                          F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out

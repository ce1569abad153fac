"""KPI star and report queries.

Star binding (definitions chosen here): one interaction per order.
was_ai_handled = priority 4 or 5; escalated = priority 1; resolved = status F.
Per-order facts from lineitem (aggregated to the order before joining):
qa_human = mean 100*(1-discount), qa_ai = mean 100*(1-8*tax), sentiment
start/end = mean discount*10 / mean tax*12.5, safety = share of lines not
returned (x100), compliance events = returned lines, critical failures =
returned lines with quantity > 45, frustration = share of returned lines,
closed at the last ship date. Geography from customer -> nation -> region.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import kpi as K, ranking, stats
from tessera.plans import bindings as B
from tessera.plans.common import rounded, tables
from tessera.plans.registry import register
from tessera.sources.bucketed import bucketed, buckets_for

W = B.with_ctes


def order_facts(li):
    ret = F.col("l_returnflag") == "R"
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.avg(100 * (1 - F.col("l_discount"))).alias("qa_human"),
        F.avg(100 * (1 - 8 * F.col("l_tax"))).alias("qa_ai"),
        (F.avg("l_discount") * 10).alias("sentiment_start"),
        (F.avg("l_tax") * 12.5).alias("sentiment_end"),
        F.avg(F.when(~ret, F.lit(100.0)).otherwise(F.lit(0.0))).alias("safety"),
        F.count_if(ret).alias("compliance_events"),
        F.count_if(ret & (F.col("l_quantity") > 45)).alias("critical_failures"),
        F.avg(F.when(ret, F.lit(1.0)).otherwise(F.lit(0.0))).alias("frustration"),
        F.max("l_shipdate").alias("closed_ts"))


def order_flags(o):
    # repeat contacts depend on order columns only: compute them on a narrow projection
    # (the bucketed look-ups re-read their input) and join back on the order key, which
    # the star is already partitioned by after its first join
    return K.repeat_flags(o.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate",
                          "o_orderkey").select(F.col("o_orderkey").alias("_fk"), "is_repeat", "next_is_repeat")


def star(spark, sf_dir):
    t = tables(spark, sf_dir)
    o, facts, flags = t.orders, order_facts(t.lineitem), order_flags(t.orders)
    return with_dimensions(t, o.join(facts, o.o_orderkey == facts.l_orderkey, "left")
                           .join(flags, o.o_orderkey == flags._fk).drop("_fk"))


def star_layout(spark, sf_dir):
    """(orders with their repeat flags, facts of the lines): one row per order each, in the
    same buckets of the order key. Written once, for any number of reports."""
    t = tables(spark, sf_dir)
    o, facts, flags = t.orders, order_facts(t.lineitem), order_flags(t.orders)
    n = buckets_for(o, t.lineitem)
    o = o.join(flags, o.o_orderkey == flags._fk).drop("_fk")
    return bucketed(o, "o_orderkey", n, "star_orders"), bucketed(facts, "l_orderkey", n, "star_facts")


def star_from_layout(spark, sf_dir, layout):
    o, facts = layout
    # both sides lie sorted in the same buckets: merged where they are, whatever their size
    return with_dimensions(tables(spark, sf_dir), o.join(facts.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left"))


def with_dimensions(t, s):
    # nation and region have fixed sizes (25 and 5 rows): proven broadcast bound
    geo = F.broadcast(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
                      .select("n_nationkey", "n_name", "r_name"))
    s = (s.join(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
         .join(geo, F.col("c_nationkey") == F.col("n_nationkey")))
    pr = F.col("o_orderpriority")
    s = K.calc_columns(s, "o_orderdate", "closed_ts", "sentiment_start", "sentiment_end",
                       pr.startswith("4") | pr.startswith("5"))
    s = (s.withColumn("escalated", pr.startswith("1"))
         .withColumn("resolved", F.col("o_orderstatus") == "F")
         .withColumnRenamed("o_orderkey", "interaction_id")
         .withColumnRenamed("o_custkey", "customer")
         .withColumnRenamed("o_orderdate", "ts")
         .withColumnRenamed("n_name", "nation").withColumnRenamed("r_name", "region")
         .withColumnRenamed("c_mktsegment", "segment"))
    return s


STAR_CTE = """li AS (SELECT l_orderkey, count(*) AS n_lines, avg(100 * (1 - l_discount)) AS qa_human,
    avg(100 * (1 - 8 * l_tax)) AS qa_ai, avg(l_discount) * 10 AS sentiment_start, avg(l_tax) * 12.5 AS sentiment_end,
    avg(CASE WHEN l_returnflag <> 'R' THEN 100.0 ELSE 0.0 END)::DOUBLE AS safety,
    count_if(l_returnflag = 'R') AS compliance_events,
    count_if(l_returnflag = 'R' AND l_quantity > 45) AS critical_failures,
    avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS frustration, max(l_shipdate) AS closed_ts
  FROM lineitem GROUP BY l_orderkey),
s0 AS (SELECT o.o_orderkey AS interaction_id, o.o_custkey AS customer, o.o_orderdate AS ts, o.o_orderstatus,
    o.o_orderpriority, o.o_totalprice, li.*, c.c_mktsegment AS segment, n.n_name AS nation, r.r_name AS region,
    (o.o_orderpriority LIKE '4%' OR o.o_orderpriority LIKE '5%') AS was_ai_handled,
    li.sentiment_end - li.sentiment_start AS sentiment_delta,
    (epoch_us(li.closed_ts) - epoch_us(o.o_orderdate)) / 60000000 AS resolution_minutes,
    o.o_orderpriority LIKE '1%' AS escalated, o.o_orderstatus = 'F' AS resolved
  FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
star AS (SELECT *,
    coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 86400000000 <= 7, false) AS is_repeat,
    coalesce((lead(epoch_us(ts)) OVER w - epoch_us(ts)) / 86400000000 <= 7, false) AS next_is_repeat
  FROM s0 WINDOW w AS (PARTITION BY customer ORDER BY ts, interaction_id))"""

R = "round({}, 6)"


STAR_VIEW = ["interaction_id", "customer", "nation", "region", "segment", "n_lines", "resolved", "escalated",
             "was_ai_handled", "is_repeat", "qa_human"]
STAR_VIEW_SQL = W(STAR_CTE) + """
SELECT interaction_id, customer, nation, region, segment, n_lines, resolved, escalated, was_ai_handled,
       is_repeat, round(qa_human, 6) AS qa_human FROM star"""


@register("star_view", ops=("C-6",), sql=STAR_VIEW_SQL)
def star_view(spark, sf_dir):
    return rounded(star(spark, sf_dir).select(*STAR_VIEW))


@register("star_view_bucketed", ops=("C-6",), sql=STAR_VIEW_SQL)
def star_view_bucketed(spark, sf_dir):
    """The star view read from tables laid out by the order key."""
    return rounded(star_from_layout(spark, sf_dir, star_layout(spark, sf_dir)).select(*STAR_VIEW))


@register("calc_columns", ops=("B-20",), sql=W(STAR_CTE) + """
SELECT interaction_id, was_ai_handled, round(sentiment_delta, 6) AS sentiment_delta,
       round(resolution_minutes, 6) AS resolution_minutes FROM star""")
def calc_columns(spark, sf_dir):
    return rounded(star(spark, sf_dir).select("interaction_id", "was_ai_handled", "sentiment_delta",
                                              "resolution_minutes"))


@register("slice_by", ops=("B-22",), sql=W(STAR_CTE) + """
SELECT interaction_id, region, segment FROM star
WHERE ts >= TIMESTAMP '1996-01-01 00:00:00' AND ts <= TIMESTAMP '1996-12-31 00:00:00'
  AND region IN ('AMERICA', 'EUROPE') AND segment = 'BUILDING' AND was_ai_handled = false""")
def slice_by(spark, sf_dir):
    s = K.slice_by(star(spark, sf_dir), ts=("1996-01-01 00:00:00", "1996-12-31 00:00:00"),
                   region=["AMERICA", "EUROPE"], segment="BUILDING", was_ai_handled=False)
    return s.select("interaction_id", "region", "segment")


@register("kpi_volume", ops=("D-10",), sql=W(STAR_CTE) + """
SELECT region, count(*) AS total, count_if(was_ai_handled) AS ai, count_if(NOT was_ai_handled) AS human,
       round(count_if(was_ai_handled) / count(*), 6) AS ai_penetration FROM star GROUP BY region""")
def kpi_volume(spark, sf_dir):
    return rounded(K.kpi_volume(star(spark, sf_dir), ["region"]))


@register("kpi_quality", ops=("D-11",), sql=W(STAR_CTE) + """
SELECT region, round(avg(qa_human), 6) AS avg_qa_human, round(avg(qa_ai), 6) AS avg_qa_ai,
       round(avg(sentiment_delta), 6) AS avg_sentiment_delta,
       round(avg((sentiment_delta > 0)::DOUBLE), 6) AS improved_share FROM star GROUP BY region""")
def kpi_quality(spark, sf_dir):
    return rounded(K.kpi_quality(star(spark, sf_dir), ["region"]))


@register("kpi_efficiency", ops=("D-12",), sql=W(STAR_CTE) + """
SELECT region, round(avg(escalated::DOUBLE), 6) AS escalation_rate, round(avg(is_repeat::DOUBLE), 6) AS repeat_rate,
       round(avg(resolution_minutes), 6) AS avg_resolution_minutes,
       round(avg((resolved AND NOT next_is_repeat)::DOUBLE), 6) AS fcr FROM star GROUP BY region""")
def kpi_efficiency(spark, sf_dir):
    return rounded(K.kpi_efficiency(star(spark, sf_dir), ["region"]))


@register("kpi_compliance", ops=("D-13",), sql=W(STAR_CTE) + """
SELECT region, sum(compliance_events) AS compliance_events, sum(critical_failures) AS critical_failures,
       round(avg(frustration), 6) AS frustration_index FROM star GROUP BY region""")
def kpi_compliance(spark, sf_dir):
    return rounded(K.kpi_compliance(star(spark, sf_dir), ["region"]))


HEADLINE_CTE = """h0 AS (SELECT avg(qa_human) AS q1, avg(qa_ai) AS q2, avg(sentiment_end * 100) AS q3, avg(safety) AS q4,
    avg((was_ai_handled AND resolved)::DOUBLE * 100) AS e1, avg((NOT escalated)::DOUBLE * 100) AS e2,
    avg((resolved AND NOT next_is_repeat)::DOUBLE * 100) AS e3,
    100 - sum(compliance_events) / sum(n_lines) * 100 AS c1,
    avg((critical_failures = 0)::DOUBLE * 100) AS c2, 100 - avg(frustration) * 100 AS c3 FROM star),
h AS (SELECT (q1 * 1.0 + q2 * 1.0 + q3 * 1.0 + q4 * 1.0) / 4.0 AS quality_index,
             (e1 * 1.0 + e2 * 1.0 + e3 * 1.0) / 3.0 AS efficiency_index,
             (c1 * 1.0 + c2 * 1.0 + c3 * 1.0) / 3.0 AS compliance_health FROM h0)"""


@register("kpi_headline", ops=("D-9",), sql=W(STAR_CTE, HEADLINE_CTE) + """
SELECT round(quality_index, 6) AS quality_index, round(efficiency_index, 6) AS efficiency_index,
       round(compliance_health, 6) AS compliance_health,
       round((quality_index + efficiency_index + compliance_health) / 3, 6) AS overall_cx FROM h""")
def kpi_headline(spark, sf_dir):
    return rounded(K.kpi_headline(star(spark, sf_dir)))


# Published KPI targets and their direction.
KPI_TARGETS = (("quality_index", 85.0, ">"), ("efficiency_index", 85.0, ">"),
               ("compliance_health", 95.0, ">"), ("overall_cx", 88.0, ">"))
TARGETS_SQL = "(VALUES " + ", ".join(f"('{k}', {v}, '{d}')" for k, v, d in KPI_TARGETS) + ") t(kpi, target, direction)"


@register("kpi_vs_target", ops=("D-14", "B-21"), sql=W(STAR_CTE, HEADLINE_CTE) + f""",
l AS (SELECT 'quality_index' AS kpi, round(quality_index, 6) AS value FROM h
      UNION ALL SELECT 'efficiency_index', round(efficiency_index, 6) FROM h
      UNION ALL SELECT 'compliance_health', round(compliance_health, 6) FROM h
      UNION ALL SELECT 'overall_cx', round((quality_index + efficiency_index + compliance_health) / 3, 6) FROM h)
SELECT l.kpi, l.value, t.target, t.direction,
       round(CASE WHEN t.direction = '>' THEN l.value - t.target ELSE t.target - l.value END, 6) AS gap,
       CASE WHEN l.value IS NULL OR t.target IS NULL THEN 'Grey'
            WHEN (CASE WHEN t.direction = '>' THEN l.value - t.target ELSE t.target - l.value END) >= 0 THEN 'Green'
            WHEN (CASE WHEN t.direction = '>' THEN l.value >= t.target * 0.95 ELSE l.value <= t.target / 0.95 END) THEN 'Amber'
            ELSE 'Red' END AS status
FROM l LEFT JOIN {TARGETS_SQL} ON l.kpi = t.kpi""")
def kpi_vs_target(spark, sf_dir):
    h = rounded(K.kpi_headline(star(spark, sf_dir)))
    longf = h.unpivot([], ["quality_index", "efficiency_index", "compliance_health", "overall_cx"], "kpi", "value")
    targets = spark.createDataFrame(list(KPI_TARGETS), "kpi string, target double, direction string")
    return rounded(K.kpi_vs_target(longf, targets))


@register("kpi_hierarchy", ops=("D-15",), sql="""
WITH leaf AS (SELECT CAST(o_custkey AS VARCHAR) AS node, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS value FROM orders GROUP BY 1),
links AS (SELECT CAST(c_custkey AS VARCHAR) AS child, n_name AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey
          UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
          UNION ALL SELECT r_name, 'WORLD' FROM region),
l2 AS (SELECT parent AS node, sum(value) AS value FROM leaf JOIN links ON leaf.node = links.child GROUP BY 1),
l3 AS (SELECT parent AS node, sum(value) AS value FROM l2 JOIN links ON l2.node = links.child GROUP BY 1),
l4 AS (SELECT parent AS node, sum(value) AS value FROM l3 JOIN links ON l3.node = links.child GROUP BY 1)
SELECT node, CAST(value AS DOUBLE) AS value, 1 AS level FROM leaf UNION ALL SELECT node, CAST(value AS DOUBLE), 2 FROM l2
UNION ALL SELECT node, CAST(value AS DOUBLE), 3 FROM l3 UNION ALL SELECT node, CAST(value AS DOUBLE), 4 FROM l4""")
def kpi_hierarchy(spark, sf_dir):
    t = tables(spark, sf_dir)
    leaf = t.orders.groupBy(F.col("o_custkey").cast("string").alias("node")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("value"))
    links = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .select(F.col("c_custkey").cast("string").alias("child"), F.col("n_name").alias("parent"))
             .unionByName(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
                          .select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")))
             .unionByName(t.region.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent"))))
    h = K.kpi_hierarchy(leaf, links, levels=4)
    return h.select("node", F.col("value").cast("double").alias("value"), "level")


@register("compare_groups", ops=("D-16",), sql=W(STAR_CTE) + """
SELECT region, was_ai_handled, count(*) AS n, round(avg(qa_human), 6) AS avg_qa_human,
       round(avg(resolution_minutes), 6) AS avg_resolution_minutes FROM star GROUP BY region, was_ai_handled""")
def compare_groups(spark, sf_dir):
    return rounded(K.compare_groups(star(spark, sf_dir), ["region", "was_ai_handled"],
                                    {"n": F.count(F.lit(1)), "avg_qa_human": F.avg("qa_human"),
                                     "avg_resolution_minutes": F.avg("resolution_minutes")}))


@register("driver_share", ops=("D-17",), sql=W(STAR_CTE) + """
SELECT region, segment, n, round(n / sum(n) OVER (PARTITION BY region), 6) AS share
FROM (SELECT region, segment, count(*) AS n FROM star WHERE escalated GROUP BY region, segment)""")
def driver_share(spark, sf_dir):
    s = star(spark, sf_dir).filter(F.col("escalated"))
    return rounded(K.driver_share(s, ["region"], "segment"))


@register("correlation_matrix", ops=("D-18",), sql="WITH x AS (SELECT 1) " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def correlation_matrix(spark, sf_dir):
    li = tables(spark, sf_dir).lineitem
    return rounded(stats.correlation_matrix(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@register("class_balance", ops=("D-19",), sql="""
SELECT o_orderstatus, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share
FROM orders GROUP BY o_orderstatus""")
def class_balance(spark, sf_dir):
    return rounded(K.class_balance(tables(spark, sf_dir).orders, "o_orderstatus"))


@register("hr_breakdown", ops=("D-33",), sql="""
SELECT c_mktsegment, c_nationkey, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share
FROM customer GROUP BY c_mktsegment, c_nationkey""")
def hr_breakdown(spark, sf_dir):
    return rounded(K.breakdown(tables(spark, sf_dir).customer, ["c_mktsegment", "c_nationkey"]))


@register("market_metrics", ops=("D-34",), sql="""
SELECT p_type, count(*) AS n, round(avg(l_quantity), 6) AS mean_qty,
       round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cv_qty,
       round(avg(l_extendedprice / l_quantity), 6) AS mean_price,
       round(stddev_samp(l_extendedprice / l_quantity) / avg(l_extendedprice / l_quantity), 6) AS cv_price,
       round(avg(1 - l_discount - l_tax), 6) AS margin_ratio
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""")
def market_metrics(spark, sf_dir):
    t = tables(spark, sf_dir)
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")) \
        .withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity"))
    return rounded(K.market_metrics(j, "p_type", "l_quantity", "unit_price",
                                    1 - F.col("l_discount") - F.col("l_tax")))


DAILY_CTE = """d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2),
b AS (SELECT event_type, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
cal AS (SELECT event_type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
s AS (SELECT cal.event_type, cal.day, coalesce(d.value, 0.0) AS value,
             datediff('day', DATE '1970-01-01', cal.day) AS dn
      FROM cal LEFT JOIN d ON cal.event_type = d.event_type AND cal.day = d.day)"""

TREND_CTE = DAILY_CTE + """,
tr AS (SELECT event_type, day, value,
    sum(value) OVER (PARTITION BY event_type ORDER BY dn RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS current_period,
    sum(value) OVER (PARTITION BY event_type ORDER BY dn RANGE BETWEEN 13 PRECEDING AND 7 PRECEDING) AS prior_period
  FROM s),
tr2 AS (SELECT *, CASE WHEN prior_period <> 0 THEN (current_period - prior_period) / prior_period * 100 END AS change_pct FROM tr)"""


def _daily(spark, sf_dir):
    e = tables(spark, sf_dir).events
    return ranking.fill_calendar(ranking.daily_series(e, "ts", None, ["event_type"]), ["event_type"])


def _trend(spark, sf_dir):
    e = tables(spark, sf_dir).events
    return ranking.trend(e, "ts", None, ["event_type"], window_days=7)


@register("trend", ops=("F-6",), sql=W(TREND_CTE) + """
SELECT event_type, day, value, current_period, prior_period, round(change_pct, 6) AS change_pct FROM tr2""")
def trend(spark, sf_dir):
    return rounded(_trend(spark, sf_dir))


@register("rolling_mean", ops=("F-7",), sql=W(DAILY_CTE) + """
SELECT event_type, day, value,
       round(avg(value) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling_mean
FROM s""")
def rolling_mean(spark, sf_dir):
    return rounded(ranking.rolling_mean(_daily(spark, sf_dir), ["event_type"], "day", "value", 7))


@register("confidence_band", ops=("F-8",), sql=W(STAR_CTE) + """
SELECT region, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean,
       round(avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 6) AS lower,
       round(avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 6) AS upper,
       count(o_totalprice) < 30 AS low_volume
FROM star GROUP BY region""")
def confidence_band(spark, sf_dir):
    s = star(spark, sf_dir)
    return rounded(stats.confidence_band(s, ["region"], "o_totalprice").drop("sd"))


@register("change_points", ops=("F-10",), sql=W(DAILY_CTE) + """
SELECT event_type, day, value, lag(value) OVER w AS previous, value - lag(value) OVER w AS change,
       abs(value - lag(value) OVER w) > 30 AS is_change
FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def change_points(spark, sf_dir):
    return ranking.change_points(_daily(spark, sf_dir), ["event_type"], "day", "value", 30)


@register("anomaly_z", ops=("F-11",), sql=W(DAILY_CTE) + """
SELECT event_type, day, value, round(avg(value) OVER w, 6) AS trail_mean, round(stddev_samp(value) OVER w, 6) AS trail_sd,
       round(CASE WHEN stddev_samp(value) OVER w <> 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END, 6) AS z,
       coalesce(abs(CASE WHEN stddev_samp(value) OVER w <> 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END) > 2.5, false) AS is_anomaly
FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def anomaly_z(spark, sf_dir):
    return rounded(ranking.anomaly_z(_daily(spark, sf_dir), ["event_type"], "day", "value", n=7, z=2.5))


FORECAST_SQL = """f AS (SELECT event_type, day, value, lag(value, 7) OVER w AS seasonal_naive,
    avg(value) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS moving_avg
  FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day))"""


@register("forecast_baseline", ops=("F-12",), sql=W(DAILY_CTE, FORECAST_SQL) + """
SELECT event_type, day, value, seasonal_naive, round(moving_avg, 6) AS moving_avg,
       abs(value - seasonal_naive) AS err_naive, round(abs(value - moving_avg), 6) AS err_ma FROM f""")
def forecast_baseline(spark, sf_dir):
    return rounded(ranking.forecast_baseline(_daily(spark, sf_dir), ["event_type"], "day", "value", 7, 4))


@register("forecast_backtest", ops=("F-12",), sql=W(DAILY_CTE, FORECAST_SQL) + """
SELECT event_type, round(avg(abs(value - seasonal_naive)), 6) AS mae_naive, round(avg(abs(value - moving_avg)), 6) AS mae_ma,
       count(abs(value - seasonal_naive)) AS n_scored FROM f GROUP BY event_type""")
def forecast_backtest(spark, sf_dir):
    f = ranking.forecast_baseline(_daily(spark, sf_dir), ["event_type"], "day", "value", 7, 4)
    return rounded(ranking.backtest_summary(f, ["event_type"]))


@register("forecast_scenarios", ops=("F-12",), sql=W(DAILY_CTE, FORECAST_SQL) + """
SELECT f.event_type, f.day, round(f.moving_avg, 6) AS moving_avg, sc.scenario, sc.factor,
       round(f.moving_avg * sc.factor, 6) AS scenario_forecast
FROM f CROSS JOIN (VALUES ('low', 0.9), ('base', 1.0), ('high', 1.2)) sc(scenario, factor)""")
def forecast_scenarios(spark, sf_dir):
    f = ranking.forecast_baseline(_daily(spark, sf_dir), ["event_type"], "day", "value", 7, 4)
    s = ranking.forecast_scenarios(f.select("event_type", "day", "moving_avg"), "moving_avg")
    return rounded(s)


SMOOTH_CTE = """sm AS (SELECT event_type, day, value, row_number() OVER (PARTITION BY event_type ORDER BY day) AS rn,
                          count(*) OVER (PARTITION BY event_type) AS n FROM s),
lv(event_type, alpha, rn, level) AS (
  SELECT event_type, alpha, rn, CAST(value AS DOUBLE) FROM sm, (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.5), (0.7), (0.9)) w(alpha) WHERE rn = 1
  UNION ALL
  SELECT sm.event_type, lv.alpha, sm.rn, lv.alpha * sm.value + (1.0::DOUBLE - lv.alpha) * lv.level
  FROM lv JOIN sm ON sm.event_type = lv.event_type AND sm.rn = lv.rn + 1),
bt AS (SELECT lv.event_type, lv.alpha, h.horizon, count(sm.value) AS n_origins, avg(abs(sm.value - lv.level)) AS mae
       FROM lv CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS horizon) h
       LEFT JOIN sm ON sm.event_type = lv.event_type AND sm.rn = lv.rn + h.horizon AND lv.rn >= 7
       GROUP BY 1, 2, 3)"""


@register("smoothing_backtest", ops=("F-12",), sql=W(DAILY_CTE.replace("WITH ", ""), SMOOTH_CTE).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT event_type, alpha, horizon, n_origins, round(mae, 6) AS mae FROM bt""")
def smoothing_backtest(spark, sf_dir):
    """Exponential smoothing of the daily series, tested from rolling origins."""
    return rounded(ranking.smoothing_backtest(_daily(spark, sf_dir), ["event_type"], "day", "value"))


@register("smoothing_forecast", ops=("F-12",), sql=W(DAILY_CTE.replace("WITH ", ""), SMOOTH_CTE).replace("WITH ", "WITH RECURSIVE ", 1) + """,
best AS (SELECT event_type, alpha FROM bt WHERE horizon = 1 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY mae NULLS LAST, alpha) = 1)
SELECT b.event_type, b.alpha, sm.day AS last, round(lv.level, 6) AS forecast, h.horizon
FROM best b JOIN sm ON sm.event_type = b.event_type AND sm.rn = sm.n
JOIN lv ON lv.event_type = b.event_type AND lv.alpha = b.alpha AND lv.rn = sm.rn
CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS horizon) h""")
def smoothing_forecast(spark, sf_dir):
    """The next days of each series with the weight that did best."""
    return rounded(ranking.smoothing_forecast(_daily(spark, sf_dir), ["event_type"], "day", "value"))


INSIGHT_CTE = TREND_CTE + """,
last AS (SELECT * FROM tr2 WHERE day = (SELECT max(day) FROM tr2 t WHERE t.event_type = tr2.event_type)),
ins AS (SELECT event_type, change_pct,
  event_type || ' changed by ' || CASE WHEN change_pct >= 0 THEN '+' ELSE '' END || CAST(round(change_pct, 1) AS VARCHAR)
  || '% over the last 7 days.' AS insight FROM last)"""


def _insights(spark, sf_dir):
    tr = _trend(spark, sf_dir)
    last = tr.groupBy("event_type").agg(F.max("day").alias("day"))
    return K.insight_text(tr.join(last, ["event_type", "day"]).select("event_type", "change_pct"),
                          "event_type", "change_pct", 7)


@register("insight_text", ops=("L-1",), sql=W(INSIGHT_CTE) + """
SELECT event_type, round(change_pct, 6) AS change_pct, insight FROM ins""")
def insight_text(spark, sf_dir):
    return rounded(_insights(spark, sf_dir))


@register("weekly_story", ops=("L-2",), sql=W(INSIGHT_CTE) + """
SELECT string_agg(insight, ' ' ORDER BY abs(change_pct) DESC, insight) AS story, count(*) AS n_items
FROM (SELECT * FROM ins ORDER BY abs(change_pct) DESC, insight LIMIT 3)""")
def weekly_story(spark, sf_dir):
    return K.weekly_story(_insights(spark, sf_dir), "change_pct", "insight", k=3)


@register("drill_through", ops=("L-3",), sql=W(STAR_CTE) + """
SELECT interaction_id, region, segment FROM star
WHERE escalated AND region IN (SELECT region FROM star GROUP BY region HAVING avg(escalated::DOUBLE) >= 0.2)""")
def drill_through(spark, sf_dir):
    s = star(spark, sf_dir)
    parents = K.kpi_efficiency(s, ["region"]).filter(F.col("escalation_rate") >= 0.2)
    return K.drill_through(s.filter(F.col("escalated")), parents, ["region"]).select("interaction_id", "region", "segment")

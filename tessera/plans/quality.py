"""Profiling, quality and cleaning queries (E-1 .. E-18, B-24 .. B-26)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tessera.functions.columns import epoch_micros, normalize_text
from tessera.operators import joins, quality as Q
from tessera.plans import bindings as B
from tessera.plans.common import rounded, tables
from tessera.plans.registry import register
from tessera.sources.stage import new_folder

W = B.with_ctes

CUSTOMER_COLS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _profile_sql(table, cols_types):
    parts = []
    for c, typ in cols_types:
        miss = f"{c} IS NULL" + (f" OR isnan({c})" if typ == "double" else "") \
            + (f" OR trim({c}) = ''" if typ == "string" else "")
        parts.append(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count_if({miss}) AS n_missing, "
                     f"count(DISTINCT {c}) AS n_distinct FROM {table}")
    return " UNION ALL ".join(parts)


CUSTOMER_TYPES = (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                  ("c_acctbal", "double"), ("c_mktsegment", "string"))
PROFILE_CTE = "p AS (" + _profile_sql("customer", CUSTOMER_TYPES) + ")"
PROFILE_SQL = """SELECT column_name, n_rows, n_missing, round(n_missing / n_rows, 6) AS missing_share, n_distinct,
       round(n_distinct / (n_rows - n_missing), 6) AS uniqueness,
       (n_missing / n_rows > 0.2 OR n_distinct <= 1) AS anomaly FROM p"""


@register("profile", ops=("E-1",), sql=W(PROFILE_CTE) + PROFILE_SQL)
def profile(spark, sf_dir):
    c = tables(spark, sf_dir).customer.select(*CUSTOMER_COLS)
    return rounded(Q.profile(c, exact_distinct=True))


@register("infer_nature", ops=("E-2",), sql="WITH x AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(CAST({c} AS VARCHAR)) AS n_present, "
    f"count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS n_numeric, count(DISTINCT CAST({c} AS VARCHAR)) AS n_distinct "
    f"FROM customer" for c in CUSTOMER_COLS) + """)
SELECT column_name, n_present, round(n_numeric / n_present, 6) AS numeric_share, n_distinct,
  CASE WHEN n_present = 0 THEN 'empty'
       WHEN n_numeric / n_present >= 0.95 AND n_distinct / n_present > 0.05 THEN 'quantitative'
       ELSE 'qualitative' END AS nature
FROM x""")
def infer_nature(spark, sf_dir):
    c = tables(spark, sf_dir).customer.select(*CUSTOMER_COLS)
    return rounded(Q.infer_nature(c))


GRAIN_CANDIDATES = (("l_orderkey",), ("l_partkey", "l_suppkey"), ("l_orderkey", "l_linenumber"))


@register("grain", ops=("E-3",), sql="WITH x AS (" + " UNION ALL ".join(
    f"SELECT {i} AS candidate, '{','.join(c)}' AS key_columns, {len(c)} AS width, "
    f"(SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} FROM lineitem)) AS n_distinct"
    for i, c in enumerate(GRAIN_CANDIDATES)) + """)
SELECT *, n_rows = n_distinct AS is_unique,
  (row_number() OVER (ORDER BY n_rows = n_distinct DESC, width, candidate) = 1) AND n_rows = n_distinct AS is_grain
FROM x""")
def grain(spark, sf_dir):
    return Q.grain(tables(spark, sf_dir).lineitem, GRAIN_CANDIDATES)


FIND_TABLES = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
               "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"),
               "conversations": ("conv_id", "turn", "role", "text")}


def _find_sql():
    parts = []
    for t, cols in FIND_TABLES.items():
        for width in (1, 2):
            for c in itertools.combinations(cols, width):
                dup = f"EXISTS (SELECT 1 FROM {t} GROUP BY {', '.join(c)} HAVING count(*) > 1)"
                parts.append(f"SELECT '{t}' AS table_name, '{','.join(c)}' AS key_columns, {width} AS width, (SELECT count(*) FROM {t}) AS n_rows, NOT {dup} AS is_key")
    return ("WITH x AS (" + " UNION ALL ".join(parts) + """)
SELECT table_name, key_columns, width, n_rows FROM x a WHERE is_key AND NOT EXISTS (
  SELECT 1 FROM x b WHERE b.is_key AND b.width = 1 AND a.width = 2 AND a.table_name = b.table_name
  AND list_contains(string_split(a.key_columns, ','), b.key_columns))""")


@register("find_grain", ops=("E-3",), sql=_find_sql())
def find_grain(spark, sf_dir):
    """Minimal keys of three tables, found without candidates."""
    t = tables(spark, sf_dir)
    parts = [Q.find_grain(getattr(t, name).select(*cols), cols, max_width=2).withColumn("table_name", F.lit(name)) for name, cols in FIND_TABLES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("table_name", "key_columns", "width", "n_rows")


EVENT_COLS = ("event_id", "user_id", "event_type", "value", "props")


@register("distinct_counts", ops=("E-1", "E-2"), sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM events" for c in EVENT_COLS))
def distinct_counts(spark, sf_dir):
    """Exact distinct counts of all columns by one aggregate over (column, value) pairs."""
    return Q.distinct_counts(tables(spark, sf_dir).events, EVENT_COLS)


@register("profile_by_day", ops=("E-1",), sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, true AS distinct_close FROM events" for c in EVENT_COLS))
def profile_by_day(spark, sf_dir):
    """Sketches stored per day, the first days written twice, and the profile as their
    union; ``distinct_close``: the estimate lies within 3 percent of the exact count."""
    e = tables(spark, sf_dir).events.select(*EVENT_COLS, "ts")
    e = e.withColumn("day", F.col("ts").cast("date")).drop("ts")
    store = Q.ProfileStore(spark, new_folder(spark, "profile"))
    store.put(e, "day")
    store.put(e.where(F.dayofmonth("day") <= 3), "day")  # a day that is run again replaces itself
    exact = Q.distinct_counts(e, EVENT_COLS)
    p = store.profile().join(exact.withColumnRenamed("n_distinct", "exact"), "column_name")
    return p.select("column_name", "n_rows", "n_missing", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.03 * F.col("exact")).alias("distinct_close"))


@register("quality_score", ops=("E-6",), sql=W(PROFILE_CTE) + """
SELECT round(completeness, 6) AS completeness, round(clean_columns, 6) AS clean_columns,
       round(worst_missing_share, 6) AS worst_missing_share,
       round((completeness * 0.5 + clean_columns * 0.5) / 1.0 * 100, 6) AS score
FROM (SELECT 1 - avg(n_missing / n_rows) AS completeness,
             avg(CASE WHEN NOT (n_missing / n_rows > 0.2 OR n_distinct <= 1) THEN 1.0 ELSE 0.0 END)::DOUBLE AS clean_columns,
             max(n_missing / n_rows) AS worst_missing_share FROM p)""")
def quality_score(spark, sf_dir):
    c = tables(spark, sf_dir).customer.select(*CUSTOMER_COLS)
    return rounded(Q.quality_score(Q.profile(c, exact_distinct=True)))


@register("root_causes", ops=("E-6",), sql=W(PROFILE_CTE) + """
SELECT column_name, round(n_missing / n_rows, 6) AS missing_share, n_missing AS affected_rows,
       row_number() OVER (ORDER BY n_missing / n_rows DESC, column_name) AS cause_rank FROM p""")
def root_causes(spark, sf_dir):
    c = tables(spark, sf_dir).customer.select(*CUSTOMER_COLS)
    return rounded(Q.root_causes(Q.profile(c, exact_distinct=True)))


GAPPY_SQL = """gappy AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN NULL ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment, 'x' AS kind FROM customer)"""


@register("remediation_plan", ops=("E-6",), sql=W(GAPPY_SQL) + """,
p AS (SELECT count(*) AS n, count_if(c_name IS NULL) AS m1, count_if(c_acctbal IS NULL) AS m2,
             count_if(c_name IS NULL OR c_acctbal IS NULL) AS hit FROM gappy)
SELECT 'c_custkey' AS column_name, 'keep' AS action, 0::BIGINT AS affected_rows, hit::BIGINT AS blast_radius_rows FROM p
UNION ALL SELECT 'c_name', CASE WHEN m1 / n > 0.5 THEN 'drop' WHEN m1 > 0 THEN 'impute' ELSE 'keep' END, m1::BIGINT, hit::BIGINT FROM p
UNION ALL SELECT 'c_acctbal', CASE WHEN m2 / n > 0.5 THEN 'drop' WHEN m2 > 0 THEN 'impute' ELSE 'keep' END, m2::BIGINT, hit::BIGINT FROM p
UNION ALL SELECT 'c_mktsegment', 'keep', 0, hit::BIGINT FROM p
UNION ALL SELECT 'kind', 'review', 0, hit::BIGINT FROM p""")
def remediation_plan(spark, sf_dir):
    """Customers with gaps: two thirds of the names, a fifth of the balances, and one constant column."""
    k = F.col("c_custkey")
    g = tables(spark, sf_dir).customer.select("c_custkey", F.when(k % 3 == 0, F.col("c_name")).alias("c_name"),
                                              F.when(k % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment", F.lit("x").alias("kind"))
    return Q.remediation_plan(g, Q.profile(g, exact_distinct=True))


@register("schema_drift", ops=("E-12",), sql="""
WITH a AS (SELECT column_name AS c, replace(replace(lower(column_type), 'varchar', 'string'), 'integer', 'int') AS t FROM (DESCRIBE customer)),
b AS (SELECT replace(column_name, 's_', 'c_') AS c, replace(replace(lower(column_type), 'varchar', 'string'), 'integer', 'int') AS t FROM (DESCRIBE supplier))
SELECT coalesce(a.c, b.c) AS column_name, a.t AS old_type, b.t AS new_type,
       CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' WHEN a.t <> b.t THEN 'retyped' ELSE 'same' END AS change
FROM a FULL JOIN b ON a.c = b.c""")
def schema_drift(spark, sf_dir):
    """The customer table against the supplier table under customer names."""
    t = tables(spark, sf_dir)
    new = t.supplier.select(*[F.col(c).alias(c.replace("s_", "c_")) for c in t.supplier.columns])
    return Q.schema_drift(t.customer, new)


@register("dedupe_latest_event", ops=("E-7",), sql="""
SELECT user_id, event_type, event_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def dedupe_latest_event(spark, sf_dir):
    e = tables(spark, sf_dir).events.select("user_id", "event_type", "event_id", "ts", "value")
    return Q.dedupe(e, ["user_id", "event_type"], ["ts", "event_id"], keep="last")


@register("completeness_by", ops=("E-8",), sql=W(B.INDICATOR_CTE, B.BOUNDARIES_CTE) + """
SELECT substr(b.ADM0_A3, 1, 1) AS kind, count(*) AS n_rows,
       round(avg(CASE WHEN i.prevalence IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS missing_prevalence,
       round(avg(CASE WHEN i.country IS NULL OR trim(i.country) = '' THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS missing_country
FROM boundaries b LEFT JOIN indicator i ON b.ADM0_A3 = i.iso_code GROUP BY 1""")
def completeness_by(spark, sf_dir):
    t = tables(spark, sf_dir)
    j = joins.attach_indicator(B.boundaries(t), B.indicator(t), "ADM0_A3", "iso_code")
    j = j.withColumn("kind", F.substring("ADM0_A3", 1, 1))
    return rounded(Q.completeness_by(j, ["kind"], ["prevalence", "country"]))


@register("key_consistency", ops=("E-9",), sql="""
SELECT 'lineitem.l_partkey' AS relation,
  CAST(coalesce(sum(CASE WHEN p._np IS NULL THEN c._nc END), 0) AS BIGINT) AS orphan_child_rows,
  CAST(count_if(p._np IS NULL) AS BIGINT) AS orphan_keys,
  CAST(count_if(c._nc IS NULL) AS BIGINT) AS childless_parents,
  CAST(count_if(p._np > 1) AS BIGINT) AS duplicate_parent_keys
FROM (SELECT l_partkey AS k, count(*) AS _nc FROM lineitem WHERE l_quantity > 45 GROUP BY 1) c
FULL JOIN (SELECT p_partkey AS k, count(*) AS _np FROM (SELECT p_partkey FROM part WHERE p_size < 45 UNION ALL SELECT p_partkey FROM part WHERE p_size = 1) GROUP BY 1) p ON c.k = p.k""")
def key_consistency(spark, sf_dir):
    t = tables(spark, sf_dir)
    # large orders against a part list that lacks the largest sizes and repeats the smallest
    parts = t.part.filter("p_size < 45").unionByName(t.part.filter("p_size = 1"))
    return joins.key_consistency(t.lineitem.filter("l_quantity > 45"), parts, "l_partkey", "p_partkey", "lineitem.l_partkey")


# money as exact decimals (the inputs carry two decimals), so sums do not
# depend on summation order
LINE_TOTAL = ("CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))"
              " * (1 + CAST(l_tax AS DECIMAL(4, 2)))")


@register("reconcile_order_totals", ops=("E-10",), sql=f"""
SELECT o_orderkey, CAST(round(total, 2) AS DOUBLE) AS total, CAST(round(reference, 2) AS DOUBLE) AS reference,
       CAST(round(diff, 2) AS DOUBLE) AS diff FROM (
  SELECT coalesce(g.o_orderkey, r.o_orderkey) AS o_orderkey, g.total, r.reference,
         coalesce(g.total, 0.0) - coalesce(r.reference, 0.0) AS diff
  FROM (SELECT l_orderkey AS o_orderkey, sum({LINE_TOTAL}) AS total FROM lineitem GROUP BY 1) g
  FULL JOIN (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS reference FROM orders) r
  ON g.o_orderkey = r.o_orderkey)
WHERE NOT (abs(diff) <= 0.01 * abs(coalesce(reference, 0.0)))""")
def reconcile_order_totals(spark, sf_dir):
    t = tables(spark, sf_dir)
    li = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"),
                           F.expr(LINE_TOTAL).alias("line_total"))
    ref = t.orders.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("reference"))
    r = Q.reconcile(li, ref, ["o_orderkey"], "line_total", "reference", tol=0.01)
    return r.select("o_orderkey", *[F.round(F.col(c), 2).cast("double").alias(c)
                                    for c in ("total", "reference", "diff")])


@register("week_on_week", ops=("E-10",), sql="""
SELECT week, round(total, 6) AS total, round(previous, 6) AS previous,
       round((total - previous) / previous, 6) AS rel_change,
       coalesce(abs((total - previous) / previous) > 0.5, false) AS breach
FROM (SELECT week, total, lag(total) OVER (ORDER BY week) AS previous FROM (
  SELECT CAST(date_trunc('week', ts) AS DATE) AS week, sum(CAST(value AS DECIMAL(18, 2))) AS total
  FROM events GROUP BY 1))""")
def week_on_week(spark, sf_dir):
    e = tables(spark, sf_dir).events.select("ts", F.col("value").cast("decimal(18,2)").alias("value"))
    r = Q.week_on_week(e, "ts", "value", tol=0.5)
    return rounded(r.select("week", *[F.col(c).cast("double").alias(c) for c in ("total", "previous", "rel_change")],
                            "breach"))


@register("timeliness", ops=("E-11",), sql="""
SELECT event_type AS source, max(ts) AS latest, count(*) AS n_rows,
       round(epoch_us(TIMESTAMP '2024-02-01 00:00:00' - max(ts)) / 86400000000.0, 6) AS lag_days,
       epoch_us(TIMESTAMP '2024-02-01 00:00:00' - max(ts)) / 86400000000.0 > 1.5 AS stale
FROM events GROUP BY event_type""")
def timeliness(spark, sf_dir):
    e = tables(spark, sf_dir).events
    return rounded(Q.timeliness(e, "event_type", "ts", "2024-02-01 00:00:00", 1.5)
                   .withColumnRenamed("event_type", "source"))


@register("provenance", ops=("E-13",), sql="""
SELECT max(o_orderdate) AS last_update, count(*) AS rows_kept,
       (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS units_excluded, 'o_totalprice' AS imputed_columns
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def provenance(spark, sf_dir):
    t = tables(spark, sf_dir)
    excluded = t.customer.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    return Q.provenance(t.orders, "o_orderdate", excluded, "o_custkey", ["o_totalprice"])


@register("quality_gate", ops=("E-14",), sql="""
SELECT 'completeness' AS check_name, round((SELECT avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE FROM orders), 6) AS metric,
       (SELECT avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END) FROM orders) <= 0.01 AS passed
UNION ALL
SELECT 'consistency', CAST((SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)) AS DOUBLE),
       (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)) = 0
UNION ALL
SELECT 'uniqueness', CAST((SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS DOUBLE),
       (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) = 0
UNION ALL
SELECT 'timeliness', round((SELECT epoch_us(TIMESTAMP '2024-02-01 00:00:00' - max(ts)) / 86400000000.0 FROM events), 6),
       (SELECT epoch_us(TIMESTAMP '2024-02-01 00:00:00' - max(ts)) / 86400000000.0 FROM events) <= 3
UNION ALL
SELECT 'validity', CAST((SELECT count_if(l_discount < 0 OR l_discount > 1 OR l_quantity <= 0) FROM lineitem) AS DOUBLE),
       (SELECT count_if(l_discount < 0 OR l_discount > 1 OR l_quantity <= 0) FROM lineitem) = 0""")
def quality_gate(spark, sf_dir):
    t = tables(spark, sf_dir)
    o, c, e, li = t.orders, t.customer, t.events, t.lineitem
    ref = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    lag_days = (epoch_micros(ref) - epoch_micros(F.max("ts"))) / 86_400_000_000
    checks = [
        ("completeness", o.agg(F.avg(F.col("o_totalprice").isNull().cast("double")).alias("metric")), 0.01),
        ("consistency", o.join(c, o.o_custkey == c.c_custkey, "left_anti").agg(F.count(F.lit(1)).alias("metric")), 0),
        ("uniqueness", o.agg((F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("metric")), 0),
        ("timeliness", e.agg(lag_days.alias("metric")), 3),
        ("validity", li.agg(F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 1)
                                       | (F.col("l_quantity") <= 0)).alias("metric")), 0),
    ]
    return rounded(Q.quality_gate(checks))


@register("validate_sources", ops=("E-15",), sql="""
SELECT coalesce(a.k, b.k) AS nationkey, round(a.v, 6) AS value_a, round(b.v, 6) AS value_b,
       round(a.v - b.v, 6) AS diff, round(abs(a.v - b.v) / abs(b.v), 6) AS rel_diff,
       CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'missing'
            WHEN coalesce(abs(a.v - b.v) / abs(b.v), 0.0) <= 0.05 THEN 'agree' ELSE 'disagree' END AS status
FROM (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, avg(s_acctbal) AS v FROM supplier GROUP BY 1) b ON a.k = b.k""")
def validate_sources(spark, sf_dir):
    t = tables(spark, sf_dir)
    a = t.customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.avg("c_acctbal").alias("v"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.avg("s_acctbal").alias("v"))
    # compare on values rounded like the output, so the status cannot flip on the last bit
    return rounded(joins.validate_sources(a, b, ["nationkey"], "v", tol=0.05))


@register("harmonise_parties", ops=("E-18",), sql="""
SELECT 'customer' AS source, c_custkey AS party_id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def harmonise_parties(spark, sf_dir):
    t = tables(spark, sf_dir)
    mapping = {
        "customer": {"party_id": ("c_custkey", "bigint"), "name": ("c_name", "string"),
                     "nation": ("c_nationkey", "int"), "balance": ("c_acctbal", "double"),
                     "segment": ("c_mktsegment", "string")},
        "supplier": {"party_id": ("s_suppkey", "bigint"), "name": ("s_name", "string"),
                     "nation": ("s_nationkey", "int"), "balance": ("s_acctbal", "double")},
    }
    return Q.harmonise({"customer": t.customer, "supplier": t.supplier}, mapping)


@register("cap_outliers", ops=("B-24",), sql="""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS value
FROM events, q""")
def cap_outliers(spark, sf_dir):
    e = tables(spark, sf_dir).events.select("event_id", "value")
    return rounded(Q.cap_outliers(e, ["value"]))


@register("normalize_text", ops=("B-25",), sql="""
SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(text, '^[ \\t\\n\\r\\f\\x0B]+', ''),
  '[ \\t\\n\\r\\f\\x0B]+\\z', ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text
FROM documents""")
def normalize_text_q(spark, sf_dir):
    d = tables(spark, sf_dir).documents
    return d.select("doc_id", normalize_text(F.col("text")).alias("text"))


@register("impute_median", ops=("B-26",), sql=W(B.INDICATOR_CTE, B.BOUNDARIES_CTE) + """,
j AS (SELECT b.ADM0_A3, TRY_CAST(i.prevalence AS DOUBLE) AS prevalence FROM boundaries b LEFT JOIN indicator i ON b.ADM0_A3 = i.iso_code)
SELECT ADM0_A3, round(coalesce(prevalence, (SELECT quantile_cont(prevalence, 0.5) FROM j)), 6) AS prevalence FROM j""")
def impute_median(spark, sf_dir):
    t = tables(spark, sf_dir)
    from tessera.sources.files import cast_measures
    j = joins.attach_indicator(B.boundaries(t), cast_measures(B.indicator(t), {"prevalence": "double"}),
                               "ADM0_A3", "iso_code").select("ADM0_A3", "prevalence")
    return rounded(Q.impute(j, ["prevalence"], "median"))


@register("readiness_scan", ops=("E-17",), sql="""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS miss,
                  avg(value) AS mean FROM events GROUP BY 1),
s AS (SELECT count(*) AS periods, min(n) AS min_volume, max(miss) AS max_missing,
             stddev_samp(mean) / avg(mean) AS drift_cv FROM d)
SELECT periods, min_volume, round(max_missing, 6) AS max_missing, round(drift_cv, 6) AS drift_cv,
       CASE WHEN periods >= 28 AND min_volume >= 20 AND max_missing <= 0.05 AND drift_cv <= 0.25
            THEN 'predictive' ELSE 'descriptive' END AS advice
FROM s""")
def readiness_scan(spark, sf_dir):
    from tessera.operators.quality import readiness_scan as scan
    return rounded(scan(tables(spark, sf_dir).events, "ts", "value"))


@register("prompt_audit", ops=("E-16",), sql="""
WITH u AS (SELECT c.conv_id, c.turn, c.text,
                  EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant') AS has_output,
                  EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system' AND s.turn < c.turn) AS has_template
           FROM conversations c WHERE c.role = 'user')
SELECT count(*) AS n_prompts, count_if(has_output) AS n_with_output, count_if(has_template) AS n_with_template,
       count_if(contains(text, '?')) AS n_decision_facing,
       count_if(contains(text, '?') AND NOT has_output) AS n_unreviewed_decisions
FROM u""")
def prompt_audit(spark, sf_dir):
    from tessera.operators.quality import prompt_audit as audit
    return audit(tables(spark, sf_dir).conversations)


@register("csv_ready", ops=("A-8",), sql="""
SELECT c_custkey, CASE WHEN regexp_matches(b, '^[=+\\-@\\t\\r]') THEN '''' || b ELSE b END AS acctbal_text,
       c_mktsegment FROM (SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS b, c_mktsegment FROM customer)""")
def csv_ready(spark, sf_dir):
    """Rows prepared for a spreadsheet-safe CSV export: text cells that a
    spreadsheet would run as a formula (here negative balances) get a
    leading apostrophe."""
    from tessera.sources.files import csv_ready as ready
    c = tables(spark, sf_dir).customer.select("c_custkey", F.col("c_acctbal").cast("string").alias("acctbal_text"),
                                              "c_mktsegment")
    return ready(c)

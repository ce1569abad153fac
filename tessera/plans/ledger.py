"""CRM, ledger and inventory queries over customer / orders / lineitem / part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import joins, ledger as L, ranking
from tessera.plans import bindings as B
from tessera.plans.common import rounded, tables
from tessera.plans.registry import register

W = B.with_ctes
REF_TIME = "2002-01-01 00:00:00"

# The allowed status transitions of the activity lifecycle
# (event types of the events table).
ALLOWED_TRANSITIONS = (
    ("signup", "view"), ("view", "view"), ("view", "click"), ("click", "view"),
    ("click", "click"), ("click", "purchase"), ("purchase", "view"), ("purchase", "click"),
    ("error", "view"), ("view", "error"), ("click", "error"), ("purchase", "error"),
)


def _moves(spark, sf_dir):
    return B.stock_moves(tables(spark, sf_dir))


@register("duplicate_keys", ops=("G-4",), sql="""
SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return L.duplicate_keys(tables(spark, sf_dir).orders, ["o_custkey"])


@register("stamp_created", ops=("G-5",), sql="""
SELECT c_custkey, c_name, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM customer""")
def stamp_created(spark, sf_dir):
    c = tables(spark, sf_dir).customer.select("c_custkey", "c_name")
    return L.stamp_created(c, "2024-01-01 00:00:00")


@register("stock_position", ops=("G-6",), sql=W(B.MOVES_CTE) + """
SELECT item, sum(qty) AS stock, sum(CASE WHEN qty > 0 THEN qty ELSE 0 END) AS stock_in,
       sum(CASE WHEN qty < 0 THEN -qty ELSE 0 END) AS stock_out, sum(qty) <= 0 AS sold_out
FROM moves GROUP BY item""")
def stock_position(spark, sf_dir):
    return L.stock_position(_moves(spark, sf_dir))


@register("stock_history", ops=("G-7",), sql=W(B.MOVES_CTE) + """
SELECT item, ts, move_id, kind, qty,
       sum(qty) OVER (PARTITION BY item ORDER BY ts, move_id, qty ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance
FROM moves""")
def stock_history(spark, sf_dir):
    return L.stock_history(_moves(spark, sf_dir))


@register("receipt", ops=("G-8",), sql="""
WITH l AS (SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_quantity AS DECIMAL(18, 2)) AS qty,
                  CAST(p.p_retailprice AS DECIMAL(18, 2)) AS price, CAST(l.l_discount AS DECIMAL(4, 2)) AS disc
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
t AS (SELECT *, qty * price * (1 - disc) AS line_total FROM l)
SELECT l_orderkey, l_linenumber, CAST(round(line_total, 2) AS DOUBLE) AS line_total,
       CAST(round(sum(line_total) OVER (PARTITION BY l_orderkey), 2) AS DOUBLE) AS grand_total,
       count(*) OVER (PARTITION BY l_orderkey) AS n_lines
FROM t""")
def receipt(spark, sf_dir):
    t = tables(spark, sf_dir)
    lines = (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
             .select("l_orderkey", "l_linenumber",
                     F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
                     F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
                     F.col("l_discount").cast("decimal(4,2)").alias("disc")))
    r = L.receipt(lines, "l_orderkey", "qty", "price", "disc")
    return r.select("l_orderkey", "l_linenumber",
                    F.round("line_total", 2).cast("double").alias("line_total"),
                    F.round("grand_total", 2).cast("double").alias("grand_total"), "n_lines")


ALLOWED_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED_TRANSITIONS) + ") a(from_status, to_status)"


@register("order_lifecycle", ops=("G-9",), sql=f"""
WITH t AS (SELECT user_id, event_id, ts, event_type AS to_status,
                  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status FROM events)
SELECT t.user_id, t.event_id, t.from_status, t.to_status,
       t.from_status IS NULL OR EXISTS (SELECT 1 FROM {ALLOWED_SQL} WHERE a.from_status = t.from_status AND a.to_status = t.to_status) AS legal
FROM t""")
def order_lifecycle(spark, sf_dir):
    e = tables(spark, sf_dir).events.select("user_id", "event_id", "ts", "event_type")
    allowed = spark.createDataFrame(list(ALLOWED_TRANSITIONS), "from_status string, to_status string")
    r = L.order_lifecycle(e, allowed, "user_id", "ts", "event_type", "event_id")
    return r.select("user_id", "event_id", "from_status", "to_status", "legal")


@register("payment_match", ops=("G-10",), sql="""
WITH ev AS (SELECT event_id AS evidence_id, CAST(json_extract(props, '$.k') AS BIGINT) AS ref, value AS amount
            FROM events WHERE event_type = 'purchase'),
u AS (SELECT ref, min(evidence_id) AS first_id FROM ev GROUP BY ref)
SELECT ev.evidence_id, ev.ref, ev.amount, o.o_totalprice AS order_amount,
  CASE WHEN o.o_totalprice IS NULL THEN 'unknown_order' WHEN ev.evidence_id <> u.first_id THEN 'duplicate'
       WHEN abs(ev.amount - o.o_totalprice) > 0.01 * abs(o.o_totalprice) THEN 'amount_mismatch' ELSE 'matched' END AS status
FROM ev JOIN u ON ev.ref = u.ref LEFT JOIN orders o ON o.o_orderkey = ev.ref""")
def payment_match(spark, sf_dir):
    t = tables(spark, sf_dir)
    ev = (t.events.filter(F.col("event_type") == "purchase")
          .select(F.col("event_id").alias("evidence_id"),
                  F.get_json_object("props", "$.k").cast("bigint").alias("ref"),
                  F.col("value").alias("amount")))
    r = L.payment_match(ev, t.orders, "ref", "amount", "o_orderkey", "o_totalprice")
    return r.select("evidence_id", "ref", "amount", "order_amount", "status")


RFM_SQL = f"""
WITH g AS (SELECT o_custkey, datediff('day', max(o_orderdate), TIMESTAMP '{REF_TIME}') AS recency_days,
                  count(*) AS frequency, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS monetary
           FROM orders GROUP BY o_custkey),
c AS (SELECT quantile_cont(recency_days::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS r,
             quantile_cont(frequency::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS f,
             quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS m FROM g),
s AS (SELECT g.*,
  5 - ((recency_days > c.r[1])::INT + (recency_days > c.r[2])::INT + (recency_days > c.r[3])::INT + (recency_days > c.r[4])::INT) AS r_score,
  1 + (frequency > c.f[1])::INT + (frequency > c.f[2])::INT + (frequency > c.f[3])::INT + (frequency > c.f[4])::INT AS f_score,
  1 + (monetary > c.m[1])::INT + (monetary > c.m[2])::INT + (monetary > c.m[3])::INT + (monetary > c.m[4])::INT AS m_score
  FROM g, c)
SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'champion' WHEN r_score <= 2 THEN 'at risk' ELSE 'regular' END AS segment
FROM s"""


@register("segment_customers", ops=("G-11",), sql=RFM_SQL)
def segment_customers(spark, sf_dir):
    o = tables(spark, sf_dir).orders.select(
        "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    r = L.rfm_scores(o, "o_custkey", "o_orderdate", "amount", REF_TIME)
    return r.withColumn("monetary", F.col("monetary").cast("double"))


@register("audit_trail", ops=("G-12",), sql="""
SELECT event_id, ts, user_id, event_type FROM events WHERE user_id = 7""")
def audit_trail(spark, sf_dir):
    e = tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type")
    return L.audit_trail(e, "user_id", 7, "ts", "event_id")


@register("handoff_state", ops=("G-13",), sql="""
WITH m AS (SELECT conv_id, turn, role,
                  CASE WHEN role = 'system' THEN turn END AS ctl,
                  CASE WHEN role = 'system' THEN NOT contains(lower(text), 'resume') END AS pause FROM conversations)
SELECT conv_id, turn, role,
       last(ctl IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_control,
       coalesce(last(pause IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ai_paused
FROM m""")
def handoff_state(spark, sf_dir):
    c = tables(spark, sf_dir).conversations.select("conv_id", "turn", "role", "text")
    r = L.handoff_state(c, "conv_id", "turn", F.col("role") == "system",
                        ~F.lower(F.col("text")).contains("resume"))
    return r.select("conv_id", "turn", "role", "last_control", "ai_paused")


@register("feedback_tracking", ops=("G-14",), sql=f"""
SELECT o_orderpriority, count_if(o_orderstatus <> 'F') AS n_open, count_if(o_orderstatus = 'F') AS n_closed,
       round(avg(CASE WHEN o_orderstatus <> 'F' THEN datediff('day', o_orderdate, TIMESTAMP '{REF_TIME}') END), 6) AS mean_open_age_days,
       round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS closure_rate
FROM orders GROUP BY o_orderpriority""")
def feedback_tracking(spark, sf_dir):
    o = tables(spark, sf_dir).orders
    return rounded(L.feedback_tracking(o, "o_orderpriority", "o_orderdate", F.col("o_orderstatus") == "F", REF_TIME))


POSITION_CTE = """pos AS (SELECT item, sum(qty) AS stock, sum(CASE WHEN qty > 0 THEN qty ELSE 0 END) AS stock_in,
  sum(CASE WHEN qty < 0 THEN -qty ELSE 0 END) AS stock_out, sum(qty) <= 0 AS sold_out FROM moves GROUP BY item),
reo AS (SELECT p_partkey AS item, p_size AS reorder_level FROM part)"""


@register("store_kpis", ops=("D-20",), sql=W(B.MOVES_CTE, POSITION_CTE) + """
SELECT count_if(stock <= reorder_level) AS low_stock, count_if(sold_out) AS sold_out,
       sum(stock_in) AS stock_in, sum(stock_out) AS stock_out,
       (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) FROM lineitem) AS total_sales,
       (SELECT count_if(o_orderstatus = 'O') FROM orders) AS open_orders
FROM pos LEFT JOIN reo USING (item)""")
def store_kpis(spark, sf_dir):
    t = tables(spark, sf_dir)
    pos = L.stock_position(B.stock_moves(t))
    reo = t.part.select(F.col("p_partkey").alias("item"), F.col("p_size").alias("reorder_level"))
    sales = t.lineitem.select(F.col("l_extendedprice").cast("decimal(18,2)").alias("rev"))
    r = L.store_kpis(pos, reo, "item", sales, "rev", t.orders, F.col("o_orderstatus") == "O")
    return r.withColumn("total_sales", F.col("total_sales").cast("double"))


@register("reorder_alerts", ops=("D-21",), sql=W(B.MOVES_CTE, POSITION_CTE) + """
SELECT item, stock, stock_in, stock_out, sold_out, reorder_level, round(stock / reorder_level, 6) AS risk_ratio
FROM pos JOIN reo USING (item) WHERE stock <= reorder_level""")
def reorder_alerts(spark, sf_dir):
    t = tables(spark, sf_dir)
    reo = t.part.select(F.col("p_partkey").alias("item"), F.col("p_size").alias("reorder_level"))
    return rounded(L.reorder_alerts(L.stock_position(B.stock_moves(t)), reo, "item"))


@register("revenue_leakage", ops=("D-32",), sql="""
WITH e AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS expected FROM orders GROUP BY 1),
r AS (SELECT o.o_custkey AS k, sum(CAST(l.l_extendedprice AS DECIMAL(18, 2))) AS recorded
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1)
SELECT coalesce(e.k, r.k) AS o_custkey, CAST(e.expected AS DOUBLE) AS expected, CAST(r.recorded AS DOUBLE) AS recorded,
       CAST(coalesce(e.expected, 0) - coalesce(r.recorded, 0) AS DOUBLE) AS gap
FROM e FULL JOIN r ON e.k = r.k WHERE abs(coalesce(e.expected, 0) - coalesce(r.recorded, 0)) > 1000""")
def revenue_leakage(spark, sf_dir):
    t = tables(spark, sf_dir)
    exp = t.orders.select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    rec = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
           .select("o_custkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("v")))
    r = L.leakage(exp, rec, "o_custkey", "v", 1000)
    return r.select("o_custkey", *[F.col(c).cast("double").alias(c) for c in ("expected", "recorded", "gap")])


@register("latest_per_key", ops=("F-9",), sql="""
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1""")
def latest_per_key(spark, sf_dir):
    o = tables(spark, sf_dir).orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return ranking.latest_per_key(o, ["o_custkey"], "o_orderdate", tiebreak="o_orderkey")


@register("stock_cover", ops=("F-13",), sql=W(B.MOVES_CTE, POSITION_CTE) + """,
o AS (SELECT item, sum(-qty) / 30 AS daily_out FROM moves
      WHERE ts < TIMESTAMP '1999-01-01 00:00:00' AND ts >= TIMESTAMP '1999-01-01 00:00:00' - INTERVAL 30 DAY AND qty < 0
      GROUP BY item)
SELECT pos.item, stock, stock_in, stock_out, sold_out, round(daily_out, 6) AS daily_out,
       round(stock / daily_out, 6) AS days_of_cover
FROM pos LEFT JOIN o ON pos.item = o.item""")
def stock_cover(spark, sf_dir):
    t = tables(spark, sf_dir)
    m = B.stock_moves(t)
    return rounded(L.stock_cover(L.stock_position(m), m, "item", "ts", "qty", "1999-01-01 00:00:00"))


@register("scope_rows", ops=("B-23",), sql="""
SELECT c_custkey, c_name, c_nationkey FROM customer
WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def scope_rows(spark, sf_dir):
    t = tables(spark, sf_dir)
    grants = t.nation.filter(F.col("n_regionkey") == 1).select(F.col("n_nationkey"))
    c = t.customer.select("c_custkey", "c_name", "c_nationkey")
    return L.scope_rows(c, grants, "c_nationkey", "n_nationkey")


@register("catalog_search", ops=("B-28",), sql="""
SELECT 'customer' AS entity, CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS label FROM customer
  WHERE contains(lower(c_name), '#0000001')
UNION ALL
SELECT 'part', CAST(p_partkey AS VARCHAR), p_name || ' ' || p_brand FROM part
  WHERE contains(lower(p_name || ' ' || p_brand), '#0000001')
UNION ALL
SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), '#0000001')""")
def catalog_search(spark, sf_dir):
    t = tables(spark, sf_dir)
    return L.catalog_search({"customer": (t.customer, "c_custkey", ["c_name"]),
                             "part": (t.part, "p_partkey", ["p_name", "p_brand"]),
                             "supplier": (t.supplier, "s_suppkey", ["s_name"])}, "#0000001")


RELATED_SQL = """
SELECT c.c_custkey, c.c_name, 'orders' AS relation,
       to_json({{'o_custkey': o.o_custkey, 'o_orderkey': o.o_orderkey, 'o_orderstatus': o.o_orderstatus,
                 'o_totalprice': o.o_totalprice}}) AS child_row,
       count(*) OVER (PARTITION BY o.o_custkey) AS n_related
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey {where}
UNION ALL
SELECT c.c_custkey, c.c_name, 'events',
       to_json({{'user_id': e.user_id, 'event_id': e.event_id, 'event_type': e.event_type, 'value': e.value}}),
       count(*) OVER (PARTITION BY e.user_id)
FROM customer c JOIN events e ON c.c_custkey = e.user_id {where}"""


def _related(spark, sf_dir, parent):
    t = tables(spark, sf_dir)
    children = {"orders": t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"),
                "events": t.events.select("user_id", "event_id", "event_type", "value")}
    r = joins.related_rows(parent, children, "c_custkey", {"orders": "o_custkey", "events": "user_id"})
    return r


@register("related_rows", ops=("C-3",), sql=RELATED_SQL.format(where=""))
def related_rows(spark, sf_dir):
    c = tables(spark, sf_dir).customer.select("c_custkey", "c_name")
    return _related(spark, sf_dir, c)


@register("customer_360", ops=("C-4",), sql=RELATED_SQL.format(where="WHERE contains(lower(c.c_name), '#00000012')"))
def customer_360(spark, sf_dir):
    from tessera.operators.tasks import search_rows
    c = tables(spark, sf_dir).customer.select("c_custkey", "c_name")
    found = search_rows(c, "#00000012", cols=("c_name",))
    return _related(spark, sf_dir, found)


@register("dereference", ops=("C-5",), sql="""
SELECT l.l_orderkey, l.l_linenumber, p.p_name, p.p_brand FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey""")
def dereference(spark, sf_dir):
    t = tables(spark, sf_dir)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.dereference(li, t.part, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "p_name", "p_brand")


@register("authorized_only", ops=("C-7",), sql="""
SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')""")
def authorized_only(spark, sf_dir):
    e = tables(spark, sf_dir).events.select("event_id", "user_id", "event_type")
    users = e.filter(F.col("event_type") == "signup").select("user_id")
    return joins.authorized_only(e, users, "user_id")


@register("link_actions", ops=("C-10",), sql="""
SELECT s.s_suppkey, s.s_name, count(*) AS n_moves, sum(l.l_quantity) AS qty_moved
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_suppkey, s.s_name""")
def link_actions(spark, sf_dir):
    t = tables(spark, sf_dir)
    # pre-aggregate the moves per staff member before joining the staff table
    per = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_moves"), F.sum("l_quantity").alias("qty_moved"))
    j = joins.dereference(per, t.supplier, "l_suppkey", "s_suppkey", how="inner")
    return j.select("s_suppkey", "s_name", "n_moves", "qty_moved")


@register("upsert_orders", ops=("A-10",), sql="""
WITH ch AS (SELECT l_orderkey AS o_orderkey, arg_max(l_linestatus, l_shipdate) AS o_orderstatus FROM (
              SELECT l_orderkey, l_linestatus, l_shipdate,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC,
                                        l_linestatus DESC) AS rn
              FROM lineitem) WHERE rn = 1 GROUP BY l_orderkey)
SELECT o.o_orderkey, o.o_orderstatus FROM orders o WHERE o.o_orderkey NOT IN (SELECT o_orderkey FROM ch)
UNION ALL SELECT o_orderkey, o_orderstatus FROM ch""")
def upsert_orders(spark, sf_dir):
    """Status changes (the status of the latest shipped line of an order)
    upserted onto the orders table: changed keys replaced, new keys added."""
    from tessera.sources.files import upsert
    t = tables(spark, sf_dir)
    base = t.orders.select("o_orderkey", "o_orderstatus")
    changes = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"),
                                F.struct("l_shipdate", "l_linenumber", "l_linestatus").alias("_order"))
    return upsert(base, changes, ["o_orderkey"], "_order").select("o_orderkey", "o_orderstatus")

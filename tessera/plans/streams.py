"""Batch forms of the streaming operators over ``events``.

Binding (FIXTURES): key = user_id, observation = an 'error' event at ts
("the user's task is overdue"); the item title of a user is 'user <id>'.
Streaming runs of the same operators are checked against these batch forms
in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import bindings as B
from tessera.plans.common import rounded, tables
from tessera.plans.registry import register
from tessera.sources.files import stream_source
from tessera.sources.keyed_table import KeyedTable
from tessera.sources.stage import new_folder
from tessera.streaming import alerts as A, events as E, stateful as S

W = B.with_ctes


def _errors(spark, sf_dir):
    return tables(spark, sf_dir).events.filter(F.col("event_type") == "error").select("user_id", "event_id", "ts")


def _fires(spark, sf_dir):
    return A.cooldown_replay(_errors(spark, sf_dir), "user_id", "ts", "event_id")


FIRES_CTE = """RECURSIVE e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'),
fires(user_id, ts) AS (
  SELECT user_id, min(ts) FROM e GROUP BY user_id
  UNION ALL
  SELECT f.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = f.user_id AND e.ts >= f.ts + INTERVAL 30 MINUTE)
  FROM fires f WHERE f.ts IS NOT NULL),
alerts AS (SELECT f.user_id, (SELECT min(e.event_id) FROM e WHERE e.user_id = f.user_id AND e.ts = f.ts) AS event_id, f.ts
           FROM fires f WHERE f.ts IS NOT NULL)"""


@register("cooldown_alerts", ops=("K-1",), sql=W(FIRES_CTE) + "SELECT user_id, event_id, ts FROM alerts")
def cooldown_alerts(spark, sf_dir):
    return _fires(spark, sf_dir)


@register("alert_digest", ops=("K-2",), sql=W(FIRES_CTE) + """
SELECT to_timestamp(floor(epoch_us(ts) / 60000000) * 60)::TIMESTAMP AS tick, count(*) AS n_due,
       arg_min('user ' || CAST(user_id AS VARCHAR), user_id) AS first_title,
       CASE WHEN count(*) = 1 THEN '"' || arg_min('user ' || CAST(user_id AS VARCHAR), user_id) || '" is overdue.'
            ELSE CAST(count(*) AS VARCHAR) || ' overdue tasks still open.' END AS message
FROM alerts GROUP BY 1""")
def alert_digest(spark, sf_dir):
    f = _fires(spark, sf_dir).withColumn("title", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return A.alert_digest(f, "ts", "title", "user_id")


@register("dedup_webhooks", ops=("K-3",), sql="""
SELECT event_id, user_id, event_type, ts FROM events""")
def dedup_webhooks(spark, sf_dir):
    e = tables(spark, sf_dir).events.select("event_id", "user_id", "event_type", "ts")
    # replayed deliveries: every click event arrives a second time
    replay = e.filter(F.col("event_type") == "click")
    return E.dedup_events(e.unionByName(replay), "event_id", "ts")


@register("live_kpis", ops=("K-4",), sql="""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM events GROUP BY 1, 2, 3""")
def live_kpis(spark, sf_dir):
    e = tables(spark, sf_dir).events.withColumn("value", F.col("value").cast("decimal(18,2)"))
    k = E.live_kpis(e, "ts", ["event_type"], "value")
    return k.withColumn("total", F.col("total").cast("double"))


@register("threshold_alerts", ops=("K-5",), sql="""
WITH RECURSIVE k AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n
                     FROM events GROUP BY 1, 2),
hot AS (SELECT * FROM k WHERE n > 4),
fires(event_type, window_start) AS (
  SELECT event_type, min(window_start) FROM hot GROUP BY event_type
  UNION ALL
  SELECT f.event_type, (SELECT min(h.window_start) FROM hot h WHERE h.event_type = f.event_type
                        AND h.window_start >= f.window_start + INTERVAL 3 HOUR)
  FROM fires f WHERE f.window_start IS NOT NULL)
SELECT hot.event_type, hot.window_start, hot.n FROM hot JOIN fires f
  ON hot.event_type = f.event_type AND hot.window_start = f.window_start""")
def threshold_alerts(spark, sf_dir):
    k = E.live_kpis(tables(spark, sf_dir).events, "ts", ["event_type"], "value").select("event_type", "window_start", "n")
    return A.threshold_alerts(k, "event_type", "window_start", "n", 4, 3 * 3600)


@register("stock_stream", ops=("K-6",), sql=W(B.MOVES_CTE) + """
SELECT item, sum(qty) AS stock, count(*) AS n_moves FROM moves GROUP BY item""")
def stock_stream(spark, sf_dir):
    return E.stock_stream(B.stock_moves(tables(spark, sf_dir)))


@register("late_report", ops=("K-7",), sql="""
WITH d AS (SELECT coalesce(greatest(max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY xor(event_id, 1023)
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - epoch_us(ts), 0) / 1000000, 0.0) AS lateness_s FROM events)
SELECT CASE WHEN lateness_s <= 0 THEN 'on time' WHEN lateness_s < 3600 THEN 'under 1 hour'
            WHEN lateness_s < 86400 THEN 'under 1 day' ELSE '1 day or more' END AS band,
       count(*) AS n, round(max(lateness_s), 6) AS max_lateness_s
FROM d GROUP BY 1""")
def late_report(spark, sf_dir):
    # blocks of 1,024 events arrive in reverse, so arrival isn't event order
    ev = tables(spark, sf_dir).events.withColumn("arrival", F.col("event_id").bitwiseXOR(F.lit(1023)))
    return rounded(E.late_report(ev, "user_id", "arrival", "ts"))


def _stream(spark, df, name, files, by):
    """A file stream over the rows of ``df``, written to ``files`` files."""
    return stream_source(spark, S.feed(spark, df, name, files, by), df.schema)


@register("upsert_stream", ops=("A-9", "A-10"), sql="""
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id
              FROM events GROUP BY user_id)
SELECT coalesce(l.user_id, c.c_custkey) AS user_id, coalesce(l.event_type, 'none') AS event_type,
       CASE WHEN l.user_id IS NULL THEN c.c_acctbal ELSE l.value END AS value, l.event_id
FROM customer c FULL JOIN last l ON l.user_id = c.c_custkey""")
def upsert_stream(spark, sf_dir):
    """Customers as the first base, events as a stream of edits and inserts by user, one file a batch."""
    t = tables(spark, sf_dir)
    base = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("event_type"), F.col("c_acctbal").alias("value"),
                             F.lit(None).cast("long").alias("event_id"))
    table = KeyedTable(spark, new_folder(spark, "keyed-table"), ["user_id"], "event_id")
    table.create(base)
    ev = t.events.select("user_id", "event_type", "value", "event_id")
    feed = S.feed(spark, ev, "upsert-feed", 4, "event_id")
    table.upsert_stream(stream_source(spark, feed, ev.schema, max_files_per_trigger=1), table.path.rsplit("/", 1)[-1] + "-state").awaitTermination()
    return table.read()


@register("cooldown_timers", ops=("K-1",), sql=W(FIRES_CTE) + "SELECT user_id, event_id, epoch_us(ts) AS alert_us FROM alerts")
def cooldown_timers(spark, sf_dir):
    """The cooldown rule on a stream, with state that expires by event-time timers."""
    stream = _stream(spark, _errors(spark, sf_dir), "error-feed", 4, "event_id")
    return S.run_to_files(S.cooldown_timers(stream, "user_id", "ts", "event_id"), "cooldown-timers")[1]


@register("late_report_stream", ops=("K-7",), sql="""
WITH d AS (SELECT coalesce(greatest(max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY xor(event_id, 1023)
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - epoch_us(ts), 0) / 1000000, 0.0) AS lateness_s FROM events)
SELECT CASE WHEN lateness_s <= 0 THEN 'on time' WHEN lateness_s < 3600 THEN 'under 1 hour'
            WHEN lateness_s < 86400 THEN 'under 1 day' ELSE '1 day or more' END AS band,
       count(*) AS n, round(max(lateness_s), 6) AS max_lateness_s
FROM d GROUP BY 1""")
def late_report_stream(spark, sf_dir):
    """Every row of the stream kept with its lateness; counts per band."""
    ev = tables(spark, sf_dir).events.select("user_id", F.col("event_id").bitwiseXOR(F.lit(1023)).alias("arrival"), "ts")
    rows = S.run_to_files(S.late_stream(_stream(spark, ev, "arrivals", 4, "arrival"), "user_id", "arrival", "ts"), "lateness")[1]
    return rounded(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("lateness_s").alias("max_lateness_s")))


@register("payment_match_stream", ops=("G-10",), sql="""
WITH ev AS (SELECT event_id AS evidence_id, CAST(json_extract(props, '$.k') AS BIGINT) AS ref, value AS amount
            FROM events WHERE event_type = 'purchase'),
u AS (SELECT ref, min(evidence_id) AS first_id FROM ev GROUP BY ref)
SELECT ev.evidence_id, ev.ref, ev.amount, o.o_totalprice AS order_amount,
  CASE WHEN o.o_totalprice IS NULL THEN 'unknown_order' WHEN ev.evidence_id <> u.first_id THEN 'duplicate'
       WHEN abs(ev.amount - o.o_totalprice) > 0.01 * abs(o.o_totalprice) THEN 'amount_mismatch' ELSE 'matched' END AS status
FROM ev JOIN u ON ev.ref = u.ref LEFT JOIN orders o ON o.o_orderkey = ev.ref""")
def payment_match_stream(spark, sf_dir):
    """Purchase events as evidence, orders as a stream of their own.

    The supplied order dates lie years before the events, so an order's arrival is taken as one second per
    key from 2023-12-31; a closing row on either side, a year later and without a key, moves
    the watermarks on as a heartbeat would."""
    t = tables(spark, sf_dir)
    close = F.lit("2025-01-31 00:00:00").cast("timestamp_ntz")
    ev = t.events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("evidence_id"), F.get_json_object("props", "$.k").cast("bigint").alias("ref"), F.col("value").alias("amount"), "ts")
    ev = ev.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("evidence_id"), F.lit(None).cast("long").alias("ref"), F.lit(0.0).alias("amount"), close.alias("ts")))
    start = F.lit("2023-12-31 00:00:00").cast("timestamp_ntz")
    od = t.orders.select("o_orderkey", "o_totalprice", F.timestamp_add("SECOND", F.pmod("o_orderkey", F.lit(86_400)).cast("int"), start).alias("arrived"))
    od = od.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"), close.alias("arrived")))
    r = S.payment_match_stream(_stream(spark, ev, "evidence", 2, "evidence_id"), _stream(spark, od, "orders", 2, "o_orderkey"),
                               "ref", "amount", "o_orderkey", "o_totalprice", "ts", "arrived")
    return S.run_to_files(r, "payments", count_rows=False)[1].where("evidence_id >= 0")

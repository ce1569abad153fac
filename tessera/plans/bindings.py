"""Domain entities made from the supplied tables (see FIXTURES.md part 2).

Each entity has a Spark builder and the same definition as a SQL common
table expression (``*_CTE``) for the DuckDB twins. All definitions here are
choices of this project, documented once:

indicator   per nation: share (percent) of customers with account balance
            under 2000, delivered as text like the source sheet; key 'N<n>'
boundaries  every nation ('N<n>') plus every region ('R<r>') as a
            territory without indicator data, so the left join has gaps
tasks       one per order: title, due date text, priority, tags, done
moves       stock ledger per part: opening stock p_size*10 at 1992-01-01,
            returned line quantities in, shipped (flag N/A) quantities out
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import Tables

# The reference time of the task views ("now") and the
# balance threshold of the indicator.
TASK_NOW = "1999-01-01 00:00:00"
INDICATOR_BALANCE_CUT = 2000.0


def indicator(t: Tables) -> DataFrame:
    c = t.customer
    share = (c.groupBy("c_nationkey")
             .agg((F.avg((F.col("c_acctbal") < INDICATOR_BALANCE_CUT).cast("double")) * 100)
                  .alias("share")))
    # nation has 25 rows at every scale factor: a proven broadcast bound
    return (share.join(F.broadcast(t.nation), share.c_nationkey == F.col("n_nationkey"))
            .select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("iso_code"),
                    F.col("n_name").alias("country"),
                    F.round("share", 1).cast("string").alias("prevalence")))


INDICATOR_CTE = f"""indicator AS (
  SELECT 'N' || CAST(s.c_nationkey AS VARCHAR) AS iso_code, n.n_name AS country,
         CAST(round(s.share, 1) AS VARCHAR) AS prevalence
  FROM (SELECT c_nationkey,
               avg(CASE WHEN c_acctbal < {INDICATOR_BALANCE_CUT} THEN 1.0 ELSE 0.0 END)::DOUBLE * 100 AS share
        FROM customer GROUP BY c_nationkey) s
  JOIN nation n ON s.c_nationkey = n.n_nationkey)"""


def boundaries(t: Tables) -> DataFrame:
    nat = t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ADM0_A3"),
                          F.col("n_name").alias("NAME"))
    reg = t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("ADM0_A3"),
                          F.col("r_name").alias("NAME"))
    return nat.unionByName(reg)


BOUNDARIES_CTE = """boundaries AS (
  SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS ADM0_A3, n_name AS NAME FROM nation
  UNION ALL
  SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS ADM0_A3, r_name AS NAME FROM region)"""


def tasks(t: Tables) -> DataFrame:
    o = t.orders
    pr = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("pos"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" for customer "),
                 F.col("o_custkey").cast("string")).alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("due"),
        F.when(pr.startswith("1") | pr.startswith("2"), "High")
         .when(pr.startswith("3"), "Medium").otherwise("Low").alias("priority"),
        F.concat_ws(", ", F.col("o_orderstatus"), F.substring(pr, 3, 20), F.col("o_orderstatus"))
         .alias("tags_text"),
        F.lit("").alias("notes"),
        (F.col("o_orderstatus") == "F").alias("done"),
    )


TASKS_CTE = """tasks AS (
  SELECT o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS id,
         'Order ' || CAST(o_orderkey AS VARCHAR) || ' for customer ' || CAST(o_custkey AS VARCHAR) AS title,
         strftime(o_orderdate, '%Y-%m-%d') AS due,
         CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'High'
              WHEN o_orderpriority LIKE '3%' THEN 'Medium' ELSE 'Low' END AS priority,
         o_orderstatus || ', ' || substr(o_orderpriority, 3, 20) || ', ' || o_orderstatus AS tags_text,
         '' AS notes,
         o_orderstatus = 'F' AS done
  FROM orders)"""


def stock_moves(t: Tables) -> DataFrame:
    """Signed ledger rows ``(item, ts, move_id, kind, qty)``; qty > 0 in, < 0 out."""
    opening = t.part.select(F.col("p_partkey").alias("item"),
                            F.lit("1992-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
                            F.lit(-1).cast("long").alias("move_id"),
                            F.lit("opening").alias("kind"),
                            (F.col("p_size") * 10).cast("double").alias("qty"))
    li = t.lineitem
    flow = li.select(F.col("l_partkey").alias("item"), F.col("l_shipdate").alias("ts"),
                     (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("move_id"),
                     F.when(F.col("l_returnflag") == "R", "in").otherwise("out").alias("kind"),
                     F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
                      .otherwise(-F.col("l_quantity")).alias("qty"))
    return opening.unionByName(flow)


MOVES_CTE = """moves AS (
  SELECT p_partkey AS item, TIMESTAMP '1992-01-01 00:00:00' AS ts, CAST(-1 AS BIGINT) AS move_id,
         'opening' AS kind, CAST(p_size * 10 AS DOUBLE) AS qty FROM part
  UNION ALL
  SELECT l_partkey AS item, l_shipdate AS ts, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS move_id,
         CASE WHEN l_returnflag = 'R' THEN 'in' ELSE 'out' END AS kind,
         CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS qty
  FROM lineitem)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

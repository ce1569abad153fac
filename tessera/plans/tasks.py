"""Task view queries over the task binding of ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import normalize_tags, parse_due_date
from tessera.operators import tasks as T
from tessera.plans import bindings as B
from tessera.plans.common import tables
from tessera.plans.registry import register

W = B.with_ctes
NOW = B.TASK_NOW


def _tasks(spark, sf_dir):
    return T.with_tags(B.tasks(tables(spark, sf_dir))).drop("tags_text")


TRIM_SQL = "regexp_replace(regexp_replace({x}, '^[ \\t\\n\\r\\f\\x0B]+', ''), '[ \\t\\n\\r\\f\\x0B]+\\z', '')"
TAGS_SQL = ("list_filter(list_filter(list_transform(string_split(coalesce(tags_text, ''), ','), "
            "lambda t: " + TRIM_SQL.format(x="t") + "), lambda t: t <> ''), "
            "lambda x, i: list_position(list_filter(list_transform(string_split(coalesce(tags_text, ''), ','), "
            "lambda t: " + TRIM_SQL.format(x="t") + "), lambda t: t <> ''), x) = i)[1:10]")
DUE_SQL = """CASE WHEN regexp_full_match({d}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN
  make_date(CASE WHEN CAST(substr({d}, 1, 4) AS INTEGER) < 100 THEN CAST(substr({d}, 1, 4) AS INTEGER) + 1900
                 ELSE CAST(substr({d}, 1, 4) AS INTEGER) END, 1, 1)
  + to_months(CAST(substr({d}, 6, 2) AS INTEGER) - 1) + to_days(CAST(substr({d}, 9, 2) AS INTEGER) - 1)
  + INTERVAL 86399999 MILLISECOND END"""
OVERDUE_SQL = f"coalesce(NOT done AND ({DUE_SQL.format(d='due')}) IS NOT NULL AND ({DUE_SQL.format(d='due')}) < TIMESTAMP '{NOW}', false)"
TASKS_T = B.TASKS_CTE.rstrip() + ",\ntt AS (SELECT pos, id, title, due, priority, " + TAGS_SQL + " AS tags, notes, done FROM tasks)"


@register("parse_due_date", ops=("B-2",), sql=W(B.TASKS_CTE) + f"""
SELECT id, due, {DUE_SQL.format(d='due')} AS due_end FROM tasks""")
def parse_due_date_q(spark, sf_dir):
    t = B.tasks(tables(spark, sf_dir))
    return t.select("id", "due", parse_due_date(F.col("due")).alias("due_end"))


@register("is_overdue", ops=("B-3",), sql=W(B.TASKS_CTE) + f"""
SELECT id, done, due, {OVERDUE_SQL} AS overdue FROM tasks""")
def is_overdue_q(spark, sf_dir):
    t = B.tasks(tables(spark, sf_dir))
    return t.select("id", "done", "due", T.overdue_col(NOW).alias("overdue"))


@register("normalize_tags", ops=("B-4",), sql=W(TASKS_T) + "SELECT id, tags FROM tt")
def normalize_tags_q(spark, sf_dir):
    t = B.tasks(tables(spark, sf_dir))
    return t.select("id", normalize_tags(F.col("tags_text")).alias("tags"))


NOTES_SQL = """notes AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE split_part(text, chr(10), 1) END AS title,
  CASE doc_id % 4 WHEN 0 THEN ' 2024-02-31 ' WHEN 1 THEN '2024-1-5' WHEN 2 THEN 'soon' ELSE '' END AS due FROM documents)"""


@register("validate_tasks", ops=("B-5",), sql=W(NOTES_SQL) + f"""
SELECT id, CASE WHEN {TRIM_SQL.format(x="coalesce(title, '')")} = '' THEN '{T.MSG_TITLE_REQUIRED}'
  WHEN length({TRIM_SQL.format(x="coalesce(title, '')")}) > {T.MAX_TITLE} THEN '{T.MSG_TITLE_TOO_LONG}'
  WHEN {TRIM_SQL.format(x="coalesce(due, '')")} <> '' AND ({DUE_SQL.format(d=TRIM_SQL.format(x="coalesce(due, '')"))}) IS NULL
    THEN '{T.MSG_DUE_INVALID}' END AS error
FROM notes""")
def validate_tasks_q(spark, sf_dir):
    # first lines of documents as titles (some blank, many too long), with due text of every kind
    d, i = tables(spark, sf_dir).documents, F.col("doc_id")
    notes = d.select(i.alias("id"), F.when(i % 7 == 0, "  ").otherwise(F.substring_index("text", "\n", 1)).alias("title"),
                     F.when(i % 4 == 0, " 2024-02-31 ").when(i % 4 == 1, "2024-1-5").when(i % 4 == 2, "soon").otherwise("").alias("due"))
    return T.validate_tasks(notes).select("id", "error")


@register("filter_tasks_overdue", ops=("B-6", "B-3"), sql=W(B.TASKS_CTE) + f"""
SELECT id, title, due, priority FROM tasks WHERE {OVERDUE_SQL}""")
def filter_tasks_overdue(spark, sf_dir):
    return T.filter_tasks(_tasks(spark, sf_dir), "overdue", NOW).select("id", "title", "due", "priority")


@register("filter_tasks_active", ops=("B-6",), sql=W(B.TASKS_CTE) + """
SELECT id, title, due, priority FROM tasks WHERE NOT done""")
def filter_tasks_active(spark, sf_dir):
    return T.filter_tasks(_tasks(spark, sf_dir), "active", NOW).select("id", "title", "due", "priority")


HAY_SQL = "lower(concat_ws(' ', coalesce(title, ''), coalesce(due, ''), coalesce(priority, ''), coalesce(array_to_string(tags, ','), ''), coalesce(notes, '')))"


@register("search_rows", ops=("B-7",), sql=W(TASKS_T) + f"""
SELECT id, title, due, priority FROM tt WHERE contains({HAY_SQL}, 'o,urgent')""")
def search_rows_q(spark, sf_dir):
    # the needle spans two tags: tags are joined with ',' inside the haystack
    return T.search_rows(_tasks(spark, sf_dir), "  O,URGENT ").select("id", "title", "due", "priority")


@register("search_rows_per_column", ops=("B-7",), sql=W(TASKS_T) + """
SELECT id, title FROM tt WHERE contains(lower(title), 'customer 7')
   OR contains(lower(due), 'customer 7') OR contains(lower(priority), 'customer 7')""")
def search_rows_per_column(spark, sf_dir):
    return T.search_rows(_tasks(spark, sf_dir), "Customer 7", cols=("title", "due", "priority"),
                         per_column=True).select("id", "title")


@register("employee_search", ops=("B-8",), sql="""
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE contains(lower(CAST(c_custkey AS VARCHAR)), '12') OR contains(lower(c_name), '12')""")
def employee_search_q(spark, sf_dir):
    c = tables(spark, sf_dir).customer.select("c_custkey", "c_name", "c_mktsegment")
    return T.employee_search(c, " 12 ", "c_custkey", "c_name")


@register("extent_rows", ops=("B-9",), sql="""
SELECT c_custkey, c_name FROM customer
WHERE c_custkey <= (SELECT max(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')""")
def extent_rows_q(spark, sf_dir):
    # the key column is blank except for one segment: the sheet ends at its last entry
    c = tables(spark, sf_dir).customer
    sheet = c.select("c_custkey", "c_name",
                     F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("key_cell"))
    return T.extent_rows(sheet, "key_cell", "c_custkey").select("c_custkey", "c_name")


@register("task_counters", ops=("D-6",), sql=W(B.TASKS_CTE) + f"""
SELECT count_if(NOT done) AS remaining, count_if({OVERDUE_SQL}) AS overdue, count(*) AS total FROM tasks""")
def task_counters(spark, sf_dir):
    return T.task_counters(_tasks(spark, sf_dir), NOW)


@register("count_by_priority", ops=("D-7",), sql=W(B.TASKS_CTE) + """
SELECT d.priority, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT * FROM (VALUES ('Low'), ('Medium'), ('High')) v(priority)) d
LEFT JOIN (SELECT priority, count(*) AS n FROM tasks GROUP BY priority) c ON c.priority = d.priority""")
def count_by_priority(spark, sf_dir):
    return T.count_by_domain(_tasks(spark, sf_dir), "priority", T.PRIORITIES)


@register("visible_count", ops=("D-8",), sql=W(B.TASKS_CTE) + f"""
SELECT n AS n_visible, n = 0 AS is_empty,
       CASE WHEN n = 0 THEN 'No tasks to show.' WHEN n = 1 THEN '1 task' ELSE CAST(n AS VARCHAR) || ' tasks' END AS label
FROM (SELECT count(*) AS n FROM tasks WHERE {OVERDUE_SQL} AND priority = 'High')""")
def visible_count(spark, sf_dir):
    v = T.filter_tasks(_tasks(spark, sf_dir), "overdue", NOW).filter(F.col("priority") == "High")
    return T.visible_count(v, noun="task")


TOGGLES_SQL = "SELECT CAST(l_orderkey AS VARCHAR) AS id FROM lineitem WHERE l_returnflag = 'R'"


@register("toggle_state", ops=("G-1",), sql=W(B.TASKS_CTE) + f"""
SELECT t.id, CASE WHEN coalesce(f.n, 0) % 2 = 1 THEN NOT t.done ELSE t.done END AS done
FROM tasks t LEFT JOIN (SELECT id, count(*) AS n FROM ({TOGGLES_SQL}) GROUP BY id) f ON f.id = t.id""")
def toggle_state(spark, sf_dir):
    # the toggle log: one toggle per returned line item of the order
    t = tables(spark, sf_dir)
    log = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").cast("string").alias("id"))
    return T.toggle_state(B.tasks(t), log).select("id", "done")


@register("remove_ids", ops=("G-2",), sql=W(B.TASKS_CTE) + """
SELECT id, done FROM tasks t WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderpriority = '5-LOW' AND CAST(o.o_orderkey AS VARCHAR) = t.id)""")
def remove_ids(spark, sf_dir):
    t = tables(spark, sf_dir)
    ids = t.orders.filter(F.col("o_orderpriority") == "5-LOW").select(F.col("o_orderkey").cast("string").alias("id"))
    return T.remove_ids(B.tasks(t), ids).select("id", "done")


@register("clear_done", ops=("G-2",), sql=W(B.TASKS_CTE) + "SELECT id, done FROM tasks WHERE NOT done")
def clear_done(spark, sf_dir):
    return T.clear_done(B.tasks(tables(spark, sf_dir))).select("id", "done")


@register("add_rows", ops=("G-3",), sql=W(B.TASKS_CTE) + """
SELECT id, title, done FROM tasks
UNION ALL
SELECT sha256(concat_ws(chr(1), 'Call ' || c_name, '', 'Medium')) AS id, 'Call ' || c_name AS title, false AS done
FROM customer WHERE c_acctbal < 0""")
def add_rows(spark, sf_dir):
    t = tables(spark, sf_dir)
    new = (t.customer.filter(F.col("c_acctbal") < 0)
           .select(F.concat(F.lit("Call "), F.col("c_name")).alias("title"), F.lit("").alias("due"),
                   F.lit("Medium").alias("priority")))
    return T.add_rows(B.tasks(t).select("id", "title", "due", "priority", "done"), new).select("id", "title", "done")

"""Task records: validation, filters, search, counters and lifecycle
(B-3 .. B-9, D-6 .. D-8, G-1 .. G-3).

A task frame has columns ``id, title, due (YYYY-MM-DD text), priority, tags
(array<string>), notes, done`` and an order column ``pos``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import is_overdue, normalize_tags, parse_due_date, strip_ws

# Validation messages, the priority domain and the tag cap.
MSG_TITLE_REQUIRED = "Task title is required."
MSG_TITLE_TOO_LONG = "Task title must be 120 characters or fewer."
MSG_DUE_INVALID = "Due date is invalid."
MAX_TITLE = 120
PRIORITIES = ("Low", "Medium", "High")
MAX_TAGS = 10


def validate_tasks(df: DataFrame, title: str = "title", due: str = "due") -> DataFrame:
    """Add ``error`` (null when valid), first failing rule wins (B-5):
    blank title, title longer than 120 characters, non-empty due date that
    does not parse. Title and due are whitespace-trimmed first."""
    t = strip_ws(F.coalesce(F.col(title), F.lit("")))
    d = strip_ws(F.coalesce(F.col(due), F.lit("")))
    err = (F.when(t == "", F.lit(MSG_TITLE_REQUIRED))
           .when(F.char_length(t) > MAX_TITLE, F.lit(MSG_TITLE_TOO_LONG))
           .when((d != "") & parse_due_date(d).isNull(), F.lit(MSG_DUE_INVALID)))
    return df.withColumn("error", err)


def split_valid(df: DataFrame):
    v = validate_tasks(df)
    return v.filter(F.col("error").isNull()).drop("error"), v.filter(F.col("error").isNotNull())


def with_tags(df: DataFrame, text_col: str = "tags_text", name: str = "tags") -> DataFrame:
    return df.withColumn(name, normalize_tags(F.col(text_col), MAX_TAGS))


def overdue_col(now) -> Column:
    return is_overdue(F.col("done"), F.col("due"), now)


def filter_tasks(df: DataFrame, mode: str, now) -> DataFrame:
    """all / active / done / overdue (B-6)."""
    if mode == "all":
        return df
    if mode == "active":
        return df.filter(~F.col("done"))
    if mode == "done":
        return df.filter(F.col("done"))
    if mode == "overdue":
        return df.filter(overdue_col(now))
    raise ValueError(mode)


def haystack(cols: Sequence[str], list_cols: Sequence[str] = ()) -> Column:
    """Lower-cased text of the columns joined by one space; list columns
    joined by ',' first; missing parts count as empty text."""
    parts = []
    for c in cols:
        if c in list_cols:
            parts.append(F.coalesce(F.array_join(F.col(c), ","), F.lit("")))
        else:
            parts.append(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.lower(F.concat_ws(" ", *parts))


def search_rows(df: DataFrame, needle: str, cols: Sequence[str] = ("title", "due", "priority", "tags", "notes"),
                list_cols: Sequence[str] = ("tags",), per_column: bool = False) -> DataFrame:
    """Substring search (B-7): trim+lower the needle; empty needle -> all rows.

    The needle is a literal (``contains``), never a regex. ``per_column=True``
    tests each column separately so a needle cannot match across two columns.
    """
    n = needle.strip().lower()
    if not n:
        return df
    if per_column:
        cond = None
        for c in cols:
            one = haystack([c], list_cols).contains(F.lit(n))
            cond = one if cond is None else (cond | one)
        return df.filter(cond)
    return df.filter(haystack(cols, list_cols).contains(F.lit(n)))


def employee_search(df: DataFrame, needle: str, col_a: str, col_b: str) -> DataFrame:
    """Rows whose column A or B contains the needle, case-insensitive (B-8).

    Spaces are trimmed; a blank needle is refused with ``ValueError``.
    """
    n = needle.strip(" ")
    if not n:
        raise ValueError("a blank needle matches nothing")
    nl = F.lit(n.lower())
    return df.filter(F.lower(F.col(col_a).cast("string")).contains(nl)
                     | F.lower(F.col(col_b).cast("string")).contains(nl))


def extent_rows(df: DataFrame, key: str, row_no: str) -> DataFrame:
    """Rows up to the last row whose key cell is non-empty (B-9). The bound
    is one scalar subquery."""
    present = F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")
    last = df.filter(present).select(F.max(row_no)).scalar()
    return df.filter(F.col(row_no) <= last)


def task_counters(df: DataFrame, now) -> DataFrame:
    """remaining, overdue and total in one pass (D-6)."""
    return df.agg(F.count_if(~F.col("done")).alias("remaining"),
                  F.count_if(overdue_col(now)).alias("overdue"),
                  F.count(F.lit(1)).alias("total"))


def count_by_domain(df: DataFrame, col: str, domain: Sequence[str], name: str = "n") -> DataFrame:
    """Count per value of a fixed domain, zeros kept, values outside ignored
    (D-7). The grouped counts are computed first (one row per value), then
    joined to the domain."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(v,) for v in domain], f"{col} string")
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return (dom.join(counts, col, "left")
            .select(col, F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)))


def visible_count(df: DataFrame, noun: str = "item") -> DataFrame:
    """Count of the visible rows, empty-state flag and label (D-8)."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_visible")).select(
        "n_visible", (F.col("n_visible") == 0).alias("is_empty"),
        F.when(F.col("n_visible") == 0, F.lit(f"No {noun}s to show."))
         .when(F.col("n_visible") == 1, F.lit(f"1 {noun}"))
         .otherwise(F.concat(F.col("n_visible").cast("string"), F.lit(f" {noun}s"))).alias("label"))


def toggle_state(tasks: DataFrame, log: DataFrame, id_col: str = "id") -> DataFrame:
    """Apply a toggle log (G-1): each toggle flips ``done``; the result is the
    initial value XOR the parity of the toggle count. Toggle counts are a
    grouped count (one row per id) joined back."""
    flips = log.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    j = tasks.join(flips, tasks[id_col] == F.col("_id"), "left")
    odd = F.coalesce(F.col("_n"), F.lit(0)) % 2 == 1
    return j.withColumn("done", F.when(odd, ~F.col("done")).otherwise(F.col("done"))).drop("_id", "_n")


def remove_ids(tasks: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Delete by id (G-2): left anti join."""
    return tasks.join(ids.select(F.col(id_col).alias("_id")), tasks[id_col] == F.col("_id"), "left_anti")


def clear_done(tasks: DataFrame) -> DataFrame:
    return tasks.filter(~F.col("done"))


def add_rows(tasks: DataFrame, new: DataFrame, id_mode: str = "hash") -> DataFrame:
    """Append new tasks with a generated id and ``done=false`` (G-3).

    ``id_mode='hash'``: id = sha2 of the row content (repeatable runs); equal
    rows are numbered, and the number joins the content from the second on.
    ``'uuid'``: a random UUID per row.
    """
    content = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                      for c in new.columns if c not in ("id", "done")])
    if id_mode == "hash":
        n = new.withColumn("_c", content)
        copy = F.row_number().over(Window.partitionBy("_c").orderBy(F.lit(1)))
        n = n.withColumn("_k", copy).withColumn(
            "id", F.sha2(F.when(F.col("_k") == 1, F.col("_c")).otherwise(F.concat_ws("\u0001", "_c", F.col("_k").cast("string"))), 256)).drop("_c", "_k")
    else:
        n = new.withColumn("id", F.expr("uuid()"))
    n = n.withColumn("done", F.lit(False))
    return tasks.unionByName(n, allowMissingColumns=True)

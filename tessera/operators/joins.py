"""Key joins and join reports (C-1 .. C-10, E-9, E-15).

Strategy: plain equi-joins, so Catalyst/AQE pick the physical join. A side is
hinted for broadcast only when its size is bounded by construction (a
dimension with a fixed row count) or the caller says so; otherwise AQE turns a
sort-merge join into a broadcast at runtime when the measured side is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and splits skewed
partitions. Reports that count matches aggregate each side to one row per key
*before* joining, so a hot key becomes one row and no fan-out happens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _maybe_broadcast(df: DataFrame, flag: bool) -> DataFrame:
    return F.broadcast(df) if flag else df


def attach_indicator(left: DataFrame, right: DataFrame, lkey: str, rkey: str,
                     na_matches: bool = False, broadcast_right: bool = False) -> DataFrame:
    """Left outer equi-join keeping every left row; the right key column is
    dropped; duplicate right keys multiply rows (C-1).

    ``na_matches=True`` lets null keys match each other (null-safe equality).
    """
    r = _maybe_broadcast(right, broadcast_right)
    cond = left[lkey].eqNullSafe(r[rkey]) if na_matches else left[lkey] == r[rkey]
    return left.join(r, cond, "left").drop(r[rkey])


def join_coverage(left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    """One row: rows of the left join, unmatched left rows, unmatched right
    rows, matched keys (C-2).

    Both sides are reduced to ``(key, rows)`` first; the full outer join then
    sees one row per key and side.
    """
    lk = left.groupBy(F.col(lkey).alias("_k")).agg(F.count(F.lit(1)).alias("_nl"))
    rk = right.groupBy(F.col(rkey).alias("_k")).agg(F.count(F.lit(1)).alias("_nr"))
    # null keys never match under SQL equality: keep them out of the join
    j = lk.filter(F.col("_k").isNotNull()).join(rk.filter(F.col("_k").isNotNull()), "_k", "full")
    nulls_l = lk.filter(F.col("_k").isNull()).select(F.coalesce(F.sum("_nl"), F.lit(0))).scalar()
    nulls_r = rk.filter(F.col("_k").isNull()).select(F.coalesce(F.sum("_nr"), F.lit(0))).scalar()
    return j.agg(
        (F.coalesce(F.sum(F.col("_nl") * F.coalesce(F.col("_nr"), F.lit(1))), F.lit(0)) + nulls_l)
        .alias("result_rows"),
        (F.coalesce(F.sum(F.when(F.col("_nr").isNull(), F.col("_nl"))), F.lit(0)) + nulls_l)
        .alias("left_unmatched"),
        (F.coalesce(F.sum(F.when(F.col("_nl").isNull(), F.col("_nr"))), F.lit(0)) + nulls_r)
        .alias("right_unmatched"),
        F.count_if(F.col("_nl").isNotNull() & F.col("_nr").isNotNull()).alias("matched_keys"),
    ).select(*[F.col(c).cast("long").alias(c) for c in
               ("result_rows", "left_unmatched", "right_unmatched", "matched_keys")])


def unmatched(left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    """Left rows without a partner (``left_anti``)."""
    return left.join(right.select(F.col(rkey).alias("_rk")), left[lkey] == F.col("_rk"), "left_anti")


def related_rows(parent: DataFrame, children: dict[str, DataFrame], pkey: str,
                 ckeys: dict[str, str]) -> DataFrame:
    """REF_ROWS for several child tables (C-3), long form.

    Each child is joined to the parent separately and the results are stacked
    with a ``relation`` tag, so two children never multiply each other. The
    child rows are serialised to JSON text so children with different schemas
    stack into one frame. Per-parent counts come from a grouped count joined
    on the key (no per-key list is ever built, so a parent with a third of all
    child rows is still spread over many tasks).
    """
    parts = []
    for name, child in children.items():
        ck = ckeys[name]
        counts = child.groupBy(F.col(ck).alias("_k")).agg(F.count(F.lit(1)).alias("n_related"))
        rows = child.select(F.col(ck).alias("_k"),
                            F.to_json(F.struct(*[F.col(c) for c in child.columns])).alias("child_row"))
        part = (parent.join(rows, parent[pkey] == rows["_k"], "inner")
                .join(counts, "_k", "inner")
                .select(*parent.columns, F.lit(name).alias("relation"), "child_row", "n_related"))
        parts.append(part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dereference(child: DataFrame, parent: DataFrame, fkey: str, pkey: str,
                how: str = "left", broadcast_parent: bool = False) -> DataFrame:
    """Child foreign key -> parent row (C-5)."""
    p = _maybe_broadcast(parent, broadcast_parent)
    return child.join(p, child[fkey] == p[pkey], how)


def authorized_only(events: DataFrame, users: DataFrame, key: str, user_key: str | None = None) -> DataFrame:
    """Keep events whose key appears in ``users`` (C-7): a left semi join,
    which never multiplies rows. Works stream-static as well."""
    uk = user_key or key
    allowed = users.select(F.col(uk).alias("_uk")).distinct()
    return events.join(allowed, events[key] == F.col("_uk"), "left_semi")


def key_consistency(child: DataFrame, parent: DataFrame, fkey: str, pkey: str,
                    name: str = "fk") -> DataFrame:
    """Orphans per foreign key both ways (E-9): child rows whose key has no
    parent, parent keys with no child, as one row of counts."""
    ck = child.groupBy(F.col(fkey).alias("_k")).agg(F.count(F.lit(1)).alias("_nc"))
    pk = parent.groupBy(F.col(pkey).alias("_k")).agg(F.count(F.lit(1)).alias("_np"))
    j = ck.join(pk, "_k", "full")
    return j.agg(
        F.lit(name).alias("relation"),
        F.coalesce(F.sum(F.when(F.col("_np").isNull(), F.col("_nc"))), F.lit(0)).cast("long")
         .alias("orphan_child_rows"),
        F.count_if(F.col("_np").isNull()).cast("long").alias("orphan_keys"),
        F.count_if(F.col("_nc").isNull()).cast("long").alias("childless_parents"),
        F.count_if(F.col("_np") > 1).cast("long").alias("duplicate_parent_keys"))


def validate_sources(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str,
                     tol: float = 0.05) -> DataFrame:
    """Same indicator from two sources (E-15): full outer join on keys,
    absolute and relative difference, agreement flag."""
    x = a.select(*keys, F.col(value).alias("value_a"))
    y = b.select(*keys, F.col(value).alias("value_b"))
    j = x.join(y, list(keys), "full")
    diff = F.col("value_a") - F.col("value_b")
    rel = F.try_divide(F.abs(diff), F.abs(F.col("value_b")))
    return j.select(*keys, "value_a", "value_b", diff.alias("diff"), rel.alias("rel_diff"),
                    F.when(F.col("value_a").isNull() | F.col("value_b").isNull(), "missing")
                     .when(F.coalesce(rel, F.lit(0.0)) <= tol, "agree")
                     .otherwise("disagree").alias("status"))

"""Exact batch replay of the cooldown rule (K-1) that spreads hot keys.

The rule is sequential per key: an observation alerts when it comes at
least one cooldown C after the key's previous alert. A key's whole history
would have to pass through one task to replay it in order. Instead:

1. Each key's timeline is cut into segments of length L >= C (a fixed grid
   of event time). Rows are shuffled by (key, segment) and sorted inside
   partitions, so a hot key is spread over as many tasks as it has
   segments.
2. Only the previous segment's last alert can influence a segment (an
   earlier alert is more than C before it), and it only decides where the
   segment's alert chain *enters*: at the first observation at or after
   ``last + C``. The possible entry points of a segment are its
   observations in the first C of the segment plus the first one after
   that (a fresh entry is its first observation). For every candidate
   entry the chain inside the segment is walked (vectorised numpy
   ``searchsorted``, one step per alert for all candidates at once), giving
   the candidate's last alert ("exit").
3. An exit determines the next segment's entry candidate (the first
   candidate at or after ``exit + C``): an as-of lookup done with a window
   over (key, segment). This gives a graph with one edge per candidate,
   each edge moving one segment forward.
4. A segment whose first observation comes at least C after the previous
   segment's last one is *fresh*: it starts with that observation whatever went
   before. The true entry of every other segment is the path from the fresh one
   before it. Pointer doubling (``J_{k+1} = J_k . J_k``, about log2 of the
   longest run of segments that aren't fresh rounds of joins) expands all paths
   in parallel.
5. Every segment is replayed from its true entry, in parallel.

Work: two shuffles of the rows plus joins over the candidate nodes, which
are about C/L of the rows. Every round is checkpointed into the shared
checkpoint folder. The result is exactly the sequential fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import epoch_micros, from_epoch_micros
from tessera.session import ship_library


def _runs(batches, key: str, cols: list[str]):
    """Complete (key, segment) runs of a sorted partition, as arrays of the
    columns; None after each batch, where a caller hands on what it has."""
    cur, held = None, []

    def whole():
        return held[0] if len(held) == 1 else tuple(np.concatenate(c) for c in zip(*held))

    for pdf in batches:
        if not len(pdf):
            continue
        k, sg = pdf[key].to_numpy(), pdf["_seg"].to_numpy(dtype=np.int64)
        values = [pdf[c].to_numpy() for c in cols]
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (sg[1:] != sg[:-1])])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(k)]):
            run = (k[s], sg[s])
            if run != cur and held:
                yield cur, whole()
                held = []
            cur = run
            held.append(tuple(v[s:e] for v in values))
        yield None
    if held:
        yield cur, whole()
    yield None


def _nodes_fn(key: str, cd_us: int, seg_us: int):
    def fn(batches):
        keys, parts = [], []
        for got in _runs(batches, key, ["_t"]):
            if got is None:
                if parts:
                    sizes, seg, pos, ct, ends, first, last = zip(*parts)
                    each = lambda x: np.repeat(np.array(x, np.int64), sizes)
                    yield pd.DataFrame({key: np.repeat(np.array(keys), sizes), "_seg": each(seg), "_pos": np.concatenate(pos).astype(np.int32),
                                        "_ct": np.concatenate(ct), "_exit": np.concatenate(ends), "_first": each(first), "_last": each(last)})
                    keys, parts = [], []
                continue
            (kv, seg), (t,) = got
            m = len(t)
            n_cand = min(int(np.searchsorted(t, seg * seg_us + cd_us, "left")) + 1, m)
            pos = np.arange(n_cand)
            cur = pos
            while m > 1:
                nxt = np.searchsorted(t, t[cur] + cd_us, "left")
                active = nxt < m
                if not active.any():
                    break
                cur = np.where(active, nxt, cur)
            keys.append(kv)
            parts.append((n_cand, seg, pos, t[:n_cand], t[cur], t[0], t[-1]))
    return fn


def _fires_fn(key: str, cd_us: int):
    def fn(batches):
        keys, ties, times = [], [], []
        for got in _runs(batches, key, ["_t", "_tb", "_start"]):
            if got is None:
                if keys:
                    yield pd.DataFrame({key: np.repeat(np.array(keys), [len(x) for x in times]), "_tb": np.concatenate(ties), "_t": np.concatenate(times)})
                    keys, ties, times = [], [], []
                continue
            (kv, _seg), (t, tb, start) = got
            i = int(start[0])
            fired = []
            while 0 <= i < len(t):
                fired.append(i)
                i = int(np.searchsorted(t, t[i] + cd_us, "left"))
            if fired:
                keys.append(kv)
                ties.append(tb[fired])
                times.append(t[fired])
    return fn


def replay_segments(df: DataFrame, key: str, ts: str, tiebreak: str, cooldown_seconds: int,
                    segment_seconds: int = 86_400, num_partitions: int | None = None,
                    max_rounds: int = 64) -> DataFrame:
    """Observations that raise an alert: ``(key, tiebreak, ts)``."""
    if segment_seconds < cooldown_seconds:
        raise ValueError("segment_seconds must be at least the cooldown")
    cd_us, seg_us = cooldown_seconds * 1_000_000, segment_seconds * 1_000_000
    from tessera.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)  # the shared folder of spark.checkpoint.dir
    in_types = dict(df.dtypes)
    rows = (df.select(key, F.col(tiebreak).alias("_tb"), epoch_micros(ts).alias("_t"))
            .withColumn("_seg", F.floor(F.col("_t") / F.lit(seg_us)).cast("long")))
    types = dict(rows.dtypes)

    def sorted_runs(src):
        part = src.repartition(num_partitions, key, "_seg") if num_partitions else src.repartition(key, "_seg")
        return part.sortWithinPartitions(key, "_seg", "_t", "_tb")

    # 2. candidate entries of every segment and the exit of each
    ship_library(rows.sparkSession)
    nodes = sorted_runs(rows).mapInPandas(
        _nodes_fn(key, cd_us, seg_us),
        f"{key} {types[key]}, _seg long, _pos int, _ct long, _exit long, _first long, _last long").checkpoint()

    # 3. edges: exit -> the next segment's first candidate at or after exit + C (as-of lookup)
    in_key = Window.partitionBy(key).orderBy("_seg")
    segs = nodes.filter(F.col("_pos") == 0).select(key, "_seg", "_first", "_last")
    gap = F.col("_first") - F.lag("_last").over(in_key)
    segs = segs.withColumn("_fresh", F.coalesce(gap >= F.lit(cd_us), F.lit(True)))
    # only a segment that isn't fresh needs to know how the one before it ends
    needs = ~F.lead("_fresh").over(in_key)
    segs = segs.select(key, "_seg", "_fresh", F.when(needs, F.lead("_seg").over(in_key)).alias("_next"))
    probes = (nodes.join(segs.filter(F.col("_next").isNotNull()), [key, "_seg"])
              .select(key, F.col("_next").alias("_seg"), (F.col("_exit") + F.lit(cd_us)).alias("_v"),
                      F.lit(0).alias("_kind"), F.col("_seg").alias("_s_seg"), F.col("_pos").alias("_s_pos"),
                      F.lit(None).cast("int").alias("_cpos")))
    cands = nodes.select(key, "_seg", F.col("_ct").alias("_v"), F.lit(1).alias("_kind"),
                         F.lit(None).cast("long").alias("_s_seg"), F.lit(None).cast("int").alias("_s_pos"),
                         F.col("_pos").alias("_cpos"))
    w = (Window.partitionBy(key, "_seg").orderBy("_v", "_kind", "_cpos")
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    lookup = probes.unionByName(cands).withColumn("_tgt", F.first("_cpos", ignorenulls=True).over(w))
    edges = lookup.filter(F.col("_kind") == 0).select(
        key, "_s_seg", "_s_pos", F.col("_seg").alias("_d_seg"),
        F.coalesce(F.col("_tgt"), F.lit(-1)).alias("_d_pos"))
    # a segment without an alert on the path lets the next segment start fresh
    none_edges = segs.filter(F.col("_next").isNotNull()).select(
        key, F.col("_seg").alias("_s_seg"), F.lit(-1).alias("_s_pos"),
        F.col("_next").alias("_d_seg"), F.lit(0).alias("_d_pos"))
    jump = edges.unionByName(none_edges).checkpoint()

    # 4. the paths from the fresh segments, by pointer doubling
    path = segs.filter("_fresh").select(key, "_seg", F.lit(0).alias("_pos"))
    for _ in range(max_rounds):
        if jump.isEmpty():
            break
        step = (path.join(jump, (path[key] == jump[key]) & (path["_seg"] == jump["_s_seg"])
                          & (path["_pos"] == jump["_s_pos"]))
                .select(path[key], F.col("_d_seg").alias("_seg"), F.col("_d_pos").alias("_pos")))
        path = path.unionByName(step).distinct().checkpoint()
        a, b = jump.alias("a"), jump.alias("b")
        jump = (a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._d_seg") == F.col("b._s_seg"))
                       & (F.col("a._d_pos") == F.col("b._s_pos")))
                .select(F.col(f"a.{key}").alias(key), F.col("a._s_seg").alias("_s_seg"),
                        F.col("a._s_pos").alias("_s_pos"), F.col("b._d_seg").alias("_d_seg"),
                        F.col("b._d_pos").alias("_d_pos"))).checkpoint()
    else:
        raise RuntimeError("pointer doubling did not finish")

    # 5. replay every segment from its true entry
    entries = path.filter(F.col("_pos") >= 0).withColumnRenamed("_pos", "_start")
    fires = sorted_runs(rows.join(entries, [key, "_seg"])).mapInPandas(
        _fires_fn(key, cd_us), f"{key} {types[key]}, _tb {types['_tb']}, _t long")
    ts_col = from_epoch_micros("_t").cast(in_types[ts]).alias(ts)
    if tiebreak == ts:
        return fires.select(key, ts_col)
    return fires.select(key, F.col("_tb").alias(tiebreak), ts_col)

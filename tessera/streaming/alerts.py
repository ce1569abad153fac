"""Keyed alerting with a cooldown (K-1, K-2, K-5).

Rule (K-1): for each key, an observation at time t raises an alert when
``t - last_alert >= cooldown`` (no previous alert counts as "long ago", so
the first observation always alerts); the alert time becomes the new
``last_alert``. Observations at the same instant are ordered by a
tie-break column. This is a sequential greedy rule, not a window, so:

* streaming: ``applyInPandasWithState`` keeps one value per key (the last
  alert time). An event-time timeout removes the state once the watermark
  passes ``last_alert + cooldown``; from then on no earlier observation can
  arrive and any later one alerts anyway, so dropping it is exact and the
  state stays bounded.
* batch replay: every key's timeline is cut into segments that are replayed in
  parallel; the entry of each segment is found by pointer jumping
  (:mod:`tessera.streaming.replay`), so a hot key is spread over many tasks
  and the result is still exactly the sequential fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.session import ship_library

# Check interval and per-key cooldown.
TICK_SECONDS = 60
COOLDOWN_SECONDS = 30 * 60


def _instant_micros(col: str):
    """Stream: microseconds of the zoned event time, the same clock as the
    watermark and the state timeouts."""
    return F.unix_micros(F.col(col).cast("timestamp"))


def _scan_key(t: np.ndarray, start: int, end: int, last, cooldown_us: int, out: list):
    """Alerts of one sorted key run ``t[start:end]`` given the previous alert."""
    seg = t[start:end]
    i = 0 if last is None else int(np.searchsorted(seg, last + cooldown_us, "left"))
    while i < len(seg):
        out.append(start + i)
        last = int(seg[i])
        i = int(np.searchsorted(seg, last + cooldown_us, "left"))
    return last


def cooldown_replay(df: DataFrame, key: str, ts: str, tiebreak: str,
                    cooldown_seconds: int = COOLDOWN_SECONDS, num_partitions: int | None = None,
                    segment_seconds: int = 86_400) -> DataFrame:
    """Batch replay of K-1: the observations that raise an alert, columns
    ``(key, tiebreak, ts)``. Every key's timeline is cut into segments of
    ``segment_seconds`` that are replayed in parallel
    (:mod:`tessera.streaming.replay`), so one hot key is spread over many tasks."""
    from tessera.streaming.replay import replay_segments
    return replay_segments(df, key, ts, tiebreak, cooldown_seconds, segment_seconds, num_partitions)


def cooldown_stream(events: DataFrame, key: str, ts: str, tiebreak: str,
                    cooldown_seconds: int = COOLDOWN_SECONDS, watermark: str = "1 hour") -> DataFrame:
    """Streaming K-1 with bounded keyed state (see module doc). Output rows
    ``(key, tiebreak, alert_us)``; within a micro-batch observations are
    taken in event-time order."""
    cooldown_us = cooldown_seconds * 1_000_000
    from tessera.streaming.events import with_event_time
    ev = with_event_time(events, ts, watermark).select(key, tiebreak, ts, _instant_micros(ts).alias("_t"))
    key_type = dict(ev.dtypes)[key]
    tb_type = dict(ev.dtypes)[tiebreak]
    out_schema = f"{key} {key_type}, {tiebreak} {tb_type}, alert_us long"

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(pdfs), ignore_index=True)
        # arbitrary state does not drop late rows by itself: observations behind the
        # watermark are ignored (their key's state may already be gone)
        pdf = pdf[pdf["_t"] >= state.getCurrentWatermarkMs() * 1000]
        if not len(pdf):
            return
        pdf = pdf.sort_values(["_t", tiebreak], kind="mergesort")
        t = pdf["_t"].to_numpy(dtype=np.int64)
        fired: list[int] = []
        last = _scan_key(t, 0, len(t), last, cooldown_us, fired)
        if last is not None:
            expire_ms = int(last // 1000) + cooldown_us // 1000
            if expire_ms <= state.getCurrentWatermarkMs():
                # the watermark already passed the cooldown: this alert can suppress nothing
                # that may still arrive, so the key needs no state
                if state.exists:
                    state.remove()
            else:
                state.update((int(last),))
                state.setTimeoutTimestamp(expire_ms)
        if fired:
            sel = pdf.iloc[fired]
            yield pd.DataFrame({key: sel[key].to_numpy(), tiebreak: sel[tiebreak].to_numpy(),
                                "alert_us": sel["_t"].to_numpy(dtype=np.int64)})

    ship_library(ev.sparkSession)
    return ev.groupBy(key).applyInPandasWithState(fn, out_schema, "last long", "append",
                                                  GroupStateTimeout.EventTimeTimeout)


def alert_digest(alerts: DataFrame, ts: str, title: str, pos: str,
                 tick_seconds: int = TICK_SECONDS) -> DataFrame:
    """One notification per tick (K-2): the number of alerts in the tick
    and the message; a single alert names its item, several are counted.
    The named item is the first by ``pos``."""
    from tessera.functions.columns import epoch_micros, from_epoch_micros
    tick_us = tick_seconds * 1_000_000
    tick = from_epoch_micros(F.floor(epoch_micros(ts) / tick_us) * tick_us).alias("tick")
    g = alerts.groupBy(tick).agg(F.count(F.lit(1)).alias("n_due"), F.min_by(title, pos).alias("first_title"))
    one = F.concat(F.lit('"'), F.col("first_title"), F.lit('" is overdue.'))
    many = F.concat(F.col("n_due").cast("string"), F.lit(" overdue tasks still open."))
    return g.withColumn("message", F.when(F.col("n_due") == 1, one).otherwise(many))


def threshold_alerts(kpis: DataFrame, key: str, ts: str, value: str, threshold: float,
                     cooldown_seconds: int, tiebreak: str | None = None) -> DataFrame:
    """KPI rows above a threshold, de-noised by the per-key cooldown (K-5)."""
    hot = kpis.filter(F.col(value) > threshold)
    tb = tiebreak or ts
    cols = list(dict.fromkeys([key, tb, ts]))
    fired = cooldown_replay(hot, key, ts, tb, cooldown_seconds)
    return hot.join(fired.select(*cols), cols, "left_semi")

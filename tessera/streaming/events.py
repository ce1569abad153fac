"""Event-stream operators (A-9, K-3, K-4, K-6, K-7).

Each works on a batch DataFrame and on a streaming one; the streaming form
adds a watermark so state is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark on ``ts``. Watermarks need a zoned TIMESTAMP; a
    TIMESTAMP_NTZ column is read as wall-clock time in the session time zone
    (UTC in this library's sessions) and cast first."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay)


def dedup_events(df: DataFrame, key: str, ts: str, watermark: str = "10 minutes") -> DataFrame:
    """Ignore replayed deliveries of the same event id (K-3).

    Stream: ``dropDuplicatesWithinWatermark`` (state per id lives only
    within the watermark delay). Batch: ``dropDuplicates`` on the id, a
    hash aggregate with map-side combine.
    """
    if df.isStreaming:
        return with_event_time(df, ts, watermark).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


def live_kpis(df: DataFrame, ts: str, by: Sequence[str], value: str, window: str = "1 hour",
              watermark: str | None = None) -> DataFrame:
    """Tumbling-window counts and sums (K-4). With ``watermark`` set on a
    stream, windows are finalised and their state dropped once the
    watermark passes them (append mode)."""
    src = with_event_time(df, ts, watermark) if watermark else df
    g = src.groupBy(F.window(ts, window).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), *by, "n", "total")


def stock_stream(moves: DataFrame, item: str = "item", qty: str = "qty") -> DataFrame:
    """Running stock per item (K-6): a streaming aggregation meant for
    ``outputMode('update')``; on a batch frame it is the stock position."""
    return moves.groupBy(item).agg(F.sum(qty).alias("stock"), F.count(F.lit(1)).alias("n_moves"))


# Lateness bands (upper bounds in seconds) and their labels.
LATE_BANDS = ((0, "on time"), (3600, "under 1 hour"), (86400, "under 1 day"))
LATE_LAST = "1 day or more"


def lateness_band(seconds: Column) -> Column:
    """Label of a lateness in seconds (K-7)."""
    band = None
    for bound, label in LATE_BANDS:
        cond = seconds <= bound if bound == 0 else seconds < bound
        band = F.when(cond, label) if band is None else band.when(cond, label)
    return band.otherwise(LATE_LAST)


def late_report(df: DataFrame, key: str, arrival: str, ts: str, bucket=None) -> DataFrame:
    """Late reporting (K-7, definition chosen here): in arrival order per
    key, an event is late by how far its event time lies behind the latest
    event time already received for that key; counts per lateness band.

    The running maximum is bucketed along the arrival order (default: blocks
    of a million arrival numbers), so a key with a third of all events is
    spread over many tasks."""
    from tessera.operators import windows as WB
    b = bucket if bucket is not None else F.floor(F.col(arrival) / F.lit(1_000_000))
    from tessera.functions.columns import epoch_micros
    d = df.withColumn("_t", epoch_micros(ts))
    d = WB.running(d, [key], [arrival], "_t", b, "_seen", "max", exclusive=True)
    lateness = F.greatest(F.col("_seen") - F.col("_t"), F.lit(0)) / F.lit(1_000_000)
    d = d.withColumn("lateness_s", F.coalesce(lateness, F.lit(0.0)))
    d = d.withColumn("band", lateness_band(F.col("lateness_s")))
    return d.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("lateness_s").alias("max_lateness_s"))

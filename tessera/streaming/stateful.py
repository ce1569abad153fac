"""Stateful processors on Spark's ``transformWithStateInPandas``: cooldown alerts
whose state expires (K-1), lateness of every row (K-7), and payment evidence
matched to a stream of orders (G-10).

They need the RocksDB state store; :func:`run_to_files` starts a query with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.columns import epoch_micros
from tessera.operators.ledger import payment_status
from tessera.session import checkpoint_subdir, ship_library
from tessera.sources.stage import new_folder
from tessera.streaming.alerts import COOLDOWN_SECONDS, _instant_micros, _scan_key
from tessera.streaming.events import lateness_band, with_event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a state query is started with: a join keeps its state in one store per partition instead of four.
STATE_CONF = {PROVIDER: ROCKSDB, "spark.sql.streaming.join.stateFormatVersion": "3"}
COUNT_ROWS = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
MICROS = T.StructType([T.StructField("us", T.LongType())])


def run_to_files(df: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None, once: bool = False,
                 count_rows: bool = True) -> tuple[object, DataFrame]:
    """Runs an append stream over all input there is into Parquet files; the
    finished query and the files as a table. ``once`` takes the input as one batch: a
    processor on the wall clock always asks for another batch, so it wouldn't end otherwise.
    Without ``count_rows`` the progress has no count of the state's rows, which costs a read before each write."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    conf = STATE_CONF if count_rows else STATE_CONF | {COUNT_ROWS: "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings that held when it started
        query = (df.writeStream.format("parquet").outputMode("append").option("path", path)
                 .option("checkpointLocation", checkpoint or checkpoint_subdir(spark, path.rstrip("/").rsplit("/", 1)[-1] + "-state"))
                 .trigger(**({"once": True} if once else {"availableNow": True})).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return query, spark.read.schema(df.schema).parquet(path)


class Cooldown(StatefulProcessor):
    """K-1 in event time: one value per key, the last alert. A timer at the end of the
    cooldown removes it once the watermark has passed: nothing that may still
    arrive can fall into that cooldown."""

    def __init__(self, key: str, tiebreak: str, cooldown_us: int):
        self.key, self.tiebreak, self.cooldown_us = key, tiebreak, cooldown_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", MICROS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf[pdf["t_us"] >= mark * 1000].sort_values(["t_us", self.tiebreak], kind="mergesort")
        if not len(pdf):
            return
        had = self.last.exists()
        last = int(self.last.get()[0]) if had else None
        fired: list[int] = []
        now = _scan_key(pdf["t_us"].to_numpy(np.int64), 0, len(pdf), last, self.cooldown_us, fired)
        if not fired:
            return
        if had:
            self.handle.deleteTimer(self._ends(last))
        if self._ends(now) > mark:
            self.last.update((now,))
            self.handle.registerTimer(self._ends(now))
        elif had:
            self.last.clear()
        hit = pdf.iloc[fired]
        yield pd.DataFrame({self.key: hit[self.key].to_numpy(), self.tiebreak: hit[self.tiebreak].to_numpy(), "alert_us": hit["t_us"].to_numpy(np.int64)})

    def _ends(self, us: int) -> int:
        return -(-(us + self.cooldown_us) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def cooldown_timers(events: DataFrame, key: str, ts: str, tiebreak: str, cooldown_seconds: int = COOLDOWN_SECONDS, watermark: str = "1 hour") -> DataFrame:
    """Alerts ``(key, tiebreak, alert_us)`` of a stream by event time (K-1); each
    micro-batch is taken in event-time order, rows behind the watermark are left out."""
    ship_library(events.sparkSession)
    ev = with_event_time(events, ts, watermark).select(key, tiebreak, ts, _instant_micros(ts).alias("t_us"))
    kinds = dict(ev.dtypes)
    return ev.groupBy(key).transformWithStateInPandas(
        Cooldown(key, tiebreak, cooldown_seconds * 1_000_000), f"{key} {kinds[key]}, {tiebreak} {kinds[tiebreak]}, alert_us long", "append", "EventTime")


class LiveCooldown(StatefulProcessor):
    """K-1 on the wall clock: the state is the cooldown itself, a value with a time to live."""

    def __init__(self, key: str, tiebreak: str, cooldown_ms: int):
        self.key, self.tiebreak, self.cooldown_ms = key, tiebreak, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.quiet = handle.getValueState("quiet", MICROS, self.cooldown_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min((pdf.nsmallest(1, self.tiebreak) for pdf in rows if len(pdf)), key=lambda p: p[self.tiebreak].iloc[0], default=None)
        if first is None or self.quiet.exists():
            return
        self.quiet.update((timerValues.getCurrentProcessingTimeInMs() * 1000,))
        yield first[[self.key, self.tiebreak]]

    def close(self) -> None:
        pass


def cooldown_live(events: DataFrame, key: str, tiebreak: str, cooldown_seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """Alerts ``(key, tiebreak)`` by arrival (K-1): a key that has raised one stays
    quiet for ``cooldown_seconds`` of processing time."""
    ship_library(events.sparkSession)
    ev = events.select(key, tiebreak)
    kinds = dict(ev.dtypes)
    return ev.groupBy(key).transformWithStateInPandas(
        LiveCooldown(key, tiebreak, cooldown_seconds * 1000), f"{key} {kinds[key]}, {tiebreak} {kinds[tiebreak]}", "append", "ProcessingTime")


class Lateness(StatefulProcessor):
    """K-7: the latest event time of a key seen so far; every row leaves with its lateness."""

    def __init__(self, columns: list[str], arrival: str, ttl_ms: int | None):
        self.columns, self.arrival, self.ttl_ms = columns, arrival, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", MICROS, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.arrival, kind="mergesort")
        t = pdf["t_us"].to_numpy(np.int64)
        start = int(self.seen.get()[0]) if self.seen.exists() else None
        top = np.maximum.accumulate(t if start is None else np.maximum(t, start))
        before = np.append(t[0] if start is None else start, top[:-1])
        self.seen.update((int(top[-1]),))
        yield pdf[self.columns].assign(lateness_us=np.maximum(before - t, 0))

    def close(self) -> None:
        pass


def late_stream(events: DataFrame, key: str, arrival: str, ts: str, idle_seconds: int | None = None) -> DataFrame:
    """Every row of a stream with its lateness and band (K-7): how far it lies behind the
    latest event time its key had when it arrived. No row is dropped, so on time plus late is
    the input. With ``idle_seconds`` a key that stays silent that long (wall clock) is forgotten."""
    ship_library(events.sparkSession)
    cols = [key, arrival, ts]
    # null event times can't be late and set no time: they keep the key's own
    ev = events.select(*cols, F.coalesce(epoch_micros(ts), F.lit(-(1 << 62))).alias("t_us"))
    schema = T.StructType([*(f for f in ev.schema if f.name != "t_us"), T.StructField("lateness_us", T.LongType())])
    out = ev.groupBy(key).transformWithStateInPandas(
        Lateness(cols, arrival, idle_seconds * 1000 if idle_seconds else None), schema, "append", "ProcessingTime" if idle_seconds else "None")
    late = F.when(F.col(ts).isNull(), F.lit(0.0)).otherwise(F.col("lateness_us") / F.lit(1_000_000))
    return out.select(*cols, late.alias("lateness_s"), lateness_band(late).alias("band"))


class FirstUse(StatefulProcessor):
    """The first evidence that used a reference, as a value per reference."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", MICROS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0].startswith("e"):  # evidence without an order uses nothing and leaves no state
            for pdf in rows:
                yield pdf[self.columns].assign(first_use=False)
            return
        pdf = pd.concat(list(rows), ignore_index=True)
        first = int(self.first.get()[0]) if self.first.exists() else int(pdf["evidence_id"].min())
        self.first.update((first,))
        yield pdf[self.columns].assign(first_use=pdf["evidence_id"].to_numpy() == first)

    def close(self) -> None:
        pass


def payment_match_stream(evidence: DataFrame, orders: DataFrame, ref: str, amount: str, order_key: str, order_amount: str, ts: str, order_ts: str,
                         wait: str = "1 day", valid: str = "40 days", watermark: str = "1 hour", tol: float = 0.01) -> DataFrame:
    """Payment evidence matched to orders, both streams (G-10): ``(evidence_id, ref,
    amount, order_amount, status)`` as the batch ``payment_match`` gives it.

    A stream-stream left outer join with a watermark on each side: evidence waits for an order
    that comes up to ``wait`` after it and may be ``valid`` old; what has found none
    when both watermarks have passed leaves once, as 'unknown_order'. The first evidence of a
    reference (in order of arrival, then of ``evidence_id``) uses it, later ones are
    'duplicate'; that is one value per reference that met an order."""
    ship_library(evidence.sparkSession)
    e = with_event_time(evidence.select("evidence_id", F.col(ref).alias("ref"), F.col(amount).alias("amount"), F.col(ts).alias("_ets")), "_ets", watermark)
    o = with_event_time(orders.select(F.col(order_key).alias("_ref"), F.col(order_amount).alias("order_amount"), F.col(order_ts).alias("_ots")), "_ots", watermark)
    near = (F.col("_ots") >= F.col("_ets") - F.expr(f"INTERVAL {valid}")) & (F.col("_ots") <= F.col("_ets") + F.expr(f"INTERVAL {wait}"))
    cols = ["evidence_id", "ref", "amount", "order_amount"]
    joined = e.join(o, (F.col("ref") == F.col("_ref")) & near, "left_outer").select(*cols)
    # evidence without an order uses nothing: it is dealt to groups only to be passed on
    group = F.when(F.col("order_amount").isNotNull(), F.concat(F.lit("r"), F.col("ref").cast("string"))) \
        .otherwise(F.concat(F.lit("e"), F.pmod(F.xxhash64("evidence_id"), F.lit(1024)).cast("string")))
    joined = joined.withColumn("_group", group)
    schema = T.StructType([*(joined.schema[c] for c in cols), T.StructField("first_use", T.BooleanType())])
    marked = joined.groupBy("_group").transformWithStateInPandas(FirstUse(cols), schema, "append", "None")
    status = payment_status(F.col("order_amount"), F.col("first_use"), F.col("amount"), tol)
    return marked.select(*cols, status.alias("status"))


def feed(spark: SparkSession, df: DataFrame, name: str, files: int, by: str) -> str:
    """Rows written to a folder that a file stream reads."""
    path = new_folder(spark, name)
    df.repartitionByRange(files, by).write.parquet(path)
    return path

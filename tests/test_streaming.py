"""K-ops: batch replay vs brute force, and stream vs batch parity."""

import datetime as dt
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.session import checkpoint_subdir
from tessera.streaming import alerts as A, events as E
from tessera.sources.files import stream_source

BASE = dt.datetime(2024, 1, 1, 8, 0, 0)


def fold(rows, cooldown_s=1800):
    """Reference fold: rows (key, id, ts) -> fired (key, id)."""
    out, last = set(), {}
    for k, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if k not in last or (t - last[k]).total_seconds() >= cooldown_s:
            out.add((k, i))
            last[k] = t
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz")


def test_cooldown_edges(spark):
    offs = [dt.timedelta(0), dt.timedelta(minutes=29, seconds=59, milliseconds=999),
            dt.timedelta(minutes=30), dt.timedelta(minutes=61)]
    rows = [(1, i, BASE + o) for i, o in enumerate(offs)]
    got = {r["event_id"] for r in A.cooldown_replay(frame(spark, rows), "user_id", "ts", "event_id").collect()}
    assert got == {0, 2, 3}


@pytest.mark.parametrize("hours", [3, 24])
def test_cooldown_replay_matches_fold(spark, hours):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        k = 0 if i % 3 == 0 else rng.randint(1, 30)  # key 0 holds a third of the rows
        rows.append((k, i, BASE + dt.timedelta(seconds=rng.randint(0, 5 * 86400))))
    rows += [(5, 10_000 + j, rows[10][2]) for j in range(3)]  # same-instant ties
    got = {(r["user_id"], r["event_id"]) for r in
           A.cooldown_replay(frame(spark, rows), "user_id", "ts", "event_id", num_partitions=4,
                             segment_seconds=hours * 3600).collect()}
    assert got == fold(rows)


def test_segmented_replay_dense_and_periodic(spark):
    # dense data keeps a chain's phase forever and periodic data never lets two chains merge:
    # the segment entries must come from the pointer jumping, not from local guesses
    rng = random.Random(2)
    dense = [(7, i, BASE + dt.timedelta(seconds=rng.randint(0, 2 * 86400))) for i in range(8000)]
    periodic = [(1, 10_000 + i, BASE + dt.timedelta(minutes=17 * i)) for i in range(600)]
    rows = dense + periodic
    got = {(r["user_id"], r["event_id"]) for r in
           A.cooldown_replay(frame(spark, rows), "user_id", "ts", "event_id",
                             segment_seconds=3600).collect()}
    assert got == fold(rows)


def test_library_reaches_workers_in_another_folder(tmp_path):
    """Python functions of the library run although the workers can't import
    it from their folder or path."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", e.queries()["threshold_alerts"](s, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def _write_parts(rows, folder, parts=3):
    rows = sorted(rows, key=lambda r: r[2])
    n = len(rows)
    for p in range(parts):
        chunk = rows[p * n // parts:(p + 1) * n // parts]
        pdf = pd.DataFrame(chunk, columns=["user_id", "event_id", "ts"])
        path = os.path.join(folder, f"part-{p}.parquet")
        pdf.to_parquet(path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        t = time.time() - 100 + p
        os.utime(path, (t, t))


def test_stream_matches_batch(spark, tmp_dir):
    rng = random.Random(5)
    rows = [(rng.randint(1, 8), i, BASE + dt.timedelta(seconds=rng.randint(0, 86400))) for i in range(600)]
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    _write_parts(rows, src)
    schema = "user_id long, event_id long, ts timestamp_ntz"
    stream = stream_source(spark, src, schema, max_files_per_trigger=1)
    q = (A.cooldown_stream(stream, "user_id", "ts", "event_id")
         .writeStream.format("memory").queryName("k1_parity").outputMode("append")
         .option("checkpointLocation", checkpoint_subdir(spark, f"k1-{time.time_ns()}"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r["user_id"], r["event_id"]) for r in spark.sql("SELECT * FROM k1_parity").collect()}
    assert got == fold(rows)


def test_stream_drops_events_behind_the_watermark(spark, tmp_dir):
    # a replayed late file: its event is older than the watermark, so the stream ignores it
    # (the batch replay, which sees everything at once, alerts it)
    early = [(1, 0, BASE + dt.timedelta(hours=5)), (1, 1, BASE + dt.timedelta(hours=6))]
    late = [(2, 2, BASE)]
    src = os.path.join(tmp_dir, "late")
    os.makedirs(src)
    for p, chunk in enumerate([early, late]):
        path = os.path.join(src, f"part-{p}.parquet")
        pd.DataFrame(chunk, columns=["user_id", "event_id", "ts"]).to_parquet(
            path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        t = time.time() - 100 + p
        os.utime(path, (t, t))
    stream = stream_source(spark, src, "user_id long, event_id long, ts timestamp_ntz", max_files_per_trigger=1)
    q = (A.cooldown_stream(stream, "user_id", "ts", "event_id", watermark="1 hour")
         .writeStream.format("memory").queryName("k1_late").outputMode("append")
         .option("checkpointLocation", checkpoint_subdir(spark, f"k1late-{time.time_ns()}"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = {r["event_id"] for r in spark.sql("SELECT * FROM k1_late").collect()}
    batch = {r["event_id"] for r in A.cooldown_replay(frame(spark, early + late), "user_id", "ts", "event_id").collect()}
    assert streamed == {0, 1} and batch == {0, 1, 2}


def test_dedup_stream_and_batch(spark, tmp_dir):
    rows = [(1, i, BASE + dt.timedelta(minutes=i)) for i in range(50)]
    dup = rows + rows[:10]
    batch = E.dedup_events(frame(spark, dup), "event_id", "ts")
    assert batch.count() == 50
    src = os.path.join(tmp_dir, "dup")
    os.makedirs(src)
    _write_parts(dup, src, parts=2)
    s = stream_source(spark, src, "user_id long, event_id long, ts timestamp_ntz")
    q = (E.dedup_events(s, "event_id", "ts", "1 day").writeStream.format("memory").queryName("k3_dedup")
         .option("checkpointLocation", checkpoint_subdir(spark, f"k3-{time.time_ns()}"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert spark.sql("SELECT count(*) AS n, count(DISTINCT event_id) AS d FROM k3_dedup").first() == (50, 50)


def test_live_kpis_stream_matches_batch(spark, tmp_dir):
    rng = random.Random(9)
    rows = [(rng.randint(1, 3), i, BASE + dt.timedelta(minutes=rng.randint(0, 600))) for i in range(300)]
    src = os.path.join(tmp_dir, "kpi")
    os.makedirs(src)
    _write_parts(rows, src)
    s = stream_source(spark, src, "user_id long, event_id long, ts timestamp_ntz").withColumn("value", F.lit(1.0))
    q = (E.live_kpis(s, "ts", ["user_id"], "value", "1 hour", watermark="2 hours").writeStream.format("memory")
         .queryName("k4_kpis").outputMode("append")
         .option("checkpointLocation", checkpoint_subdir(spark, f"k4-{time.time_ns()}"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    streamed = {tuple(r) for r in spark.sql("SELECT window_start, user_id, n FROM k4_kpis").collect()}
    batch = {tuple(r) for r in E.live_kpis(frame(spark, rows).withColumn("value", F.lit(1.0)), "ts", ["user_id"],
                                           "value").select("window_start", "user_id", "n").collect()}
    # append mode emits a window once the watermark has passed it: the last windows may still be open
    assert streamed <= batch and len(streamed) >= len(batch) - 9


def test_stock_stream_update_mode(spark, tmp_dir):
    moves = [("a", 10.0, BASE), ("b", 5.0, BASE), ("a", -3.0, BASE + dt.timedelta(hours=1)),
             ("a", -4.0, BASE + dt.timedelta(hours=2)), ("b", 1.0, BASE + dt.timedelta(hours=3))]
    src = os.path.join(tmp_dir, "moves")
    os.makedirs(src)
    for p, chunk in enumerate([moves[:2], moves[2:4], moves[4:]]):
        path = os.path.join(src, f"part-{p}.parquet")
        pd.DataFrame(chunk, columns=["item", "qty", "ts"]).to_parquet(
            path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        t = time.time() - 100 + p
        os.utime(path, (t, t))
    s = stream_source(spark, src, "item string, qty double, ts timestamp_ntz", max_files_per_trigger=1)
    q = (E.stock_stream(s).writeStream.format("memory").queryName("k6_stock").outputMode("update")
         .option("checkpointLocation", checkpoint_subdir(spark, f"k6-{time.time_ns()}"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    # update mode: every micro-batch re-emits the changed items; the last value per item is the stock
    rows = spark.sql("SELECT item, stock, n_moves FROM k6_stock").collect()
    final = {}
    for r in rows:
        if r["n_moves"] >= final.get(r["item"], (0, 0))[1]:
            final[r["item"]] = (r["stock"], r["n_moves"])
    assert {k: v[0] for k, v in final.items()} == {"a": 3.0, "b": 6.0}


def test_stream_to_files_roundtrip(spark, tmp_dir):
    from tessera.sources.files import stream_to_files
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), i, BASE + dt.timedelta(minutes=rng.randint(0, 300))) for i in range(200)]
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    _write_parts(rows, src)
    s = stream_source(spark, src, "user_id long, event_id long, ts timestamp_ntz", max_files_per_trigger=1)
    out = os.path.join(tmp_dir, "out")
    q = stream_to_files(E.dedup_events(s, "event_id", "ts", "1 day"), out, f"sink-{time.time_ns()}")
    q.awaitTermination(300)
    back = spark.read.parquet(out)
    assert back.count() == 200 and back.select("event_id").distinct().count() == 200


def test_alert_digest_messages(spark):
    rows = [(3, "user 3", BASE), (1, "user 1", BASE + dt.timedelta(seconds=10)),
            (2, "user 2", BASE + dt.timedelta(minutes=5))]
    df = spark.createDataFrame(rows, "pos long, title string, ts timestamp_ntz")
    got = {r["n_due"]: r["message"] for r in A.alert_digest(df, "ts", "title", "pos").collect()}
    assert got == {2: "2 overdue tasks still open.", 1: '"user 2" is overdue.'}


def test_late_report_bands(spark):
    rows = [(1, 0, BASE + dt.timedelta(hours=5)), (1, 1, BASE + dt.timedelta(hours=4, minutes=30)),
            (1, 2, BASE), (1, 3, BASE + dt.timedelta(hours=6)), (1, 4, BASE - dt.timedelta(days=2))]
    got = {r["band"]: r["n"] for r in E.late_report(frame(spark, rows), "user_id", "event_id", "ts").collect()}
    assert got == {"on time": 2, "under 1 hour": 1, "under 1 day": 1, "1 day or more": 1}

"""Chat exports read in blocks, the keyed table, and the stateful stream processors:
against plain reads, the batch forms and a restart in mid-batch."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import ledger as L
from tessera.session import checkpoint_subdir
from tessera.sources import files
from tessera.sources.files import stream_source, upsert
from tessera.sources.keyed_table import KeyedTable
from tessera.sources.stage import new_folder, staged
from tessera.streaming import alerts as A, events as E, stateful as S

BASE = dt.datetime(2024, 1, 1, 8)


def write_in_turn(spark, folder, frames):
    """One file a frame, in order of modification time, which file streams follow."""
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return folder


# -- A-5 -------------------------------------------------------------------------

@pytest.mark.parametrize("block", [700, 1 << 27])
def test_chat_lines_in_blocks_equal_a_plain_read(spark, tmp_dir, block):
    rng = random.Random(1)
    want = {}
    for name, ending in (("a.txt", "\n"), ("b.txt", "\r\n"), ("c.txt", "\n")):
        lines = ["".join(rng.choice("abc é\U0001F600\r ") for _ in range(rng.choice([0, 1, 30, 2000]))) + "x" for _ in range(200)]
        lines[rng.randrange(150)] = ""
        with open(os.path.join(tmp_dir, name), "w", newline="") as f:
            f.write(ending.join(lines) + ("" if name == "a.txt" else ending))
        want[name] = lines
    open(os.path.join(tmp_dir, "empty.txt"), "w").close()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        df = spark.read.option("lineSep", "\n").text(tmp_dir)
        assert df.rdd.getNumPartitions() > 50 if block == 700 else True
        rows = files.read_chat_lines(spark, tmp_dir).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got: dict = {}
    for r in rows:
        got.setdefault(os.path.basename(r["chat"]), {})[r["line_no"]] = r["line"]
    assert {n: [v[i] for i in range(len(v))] for n, v in got.items()} == want


# -- A-9, A-10 ---------------------------------------------------------------------

def changes(n=400):
    rng = random.Random(7)
    return [(rng.choice([0, 0, 0, rng.randrange(60)]), i, rng.choice(["a", "b", None])) for i in range(n)]


def test_upsert_stream_survives_a_crash_in_mid_batch(spark):
    cols = "id long, seq long, v string"
    base = spark.createDataFrame([(i, None, "base") for i in range(40)], cols)
    rows = changes()
    feed = write_in_turn(spark, new_folder(spark, "feed"), [spark.createDataFrame(rows[k::4], cols) for k in range(4)])
    table = KeyedTable(spark, new_folder(spark, "table"), ["id"], "seq")
    table.create(base)
    done = table.apply
    seen = []

    def crash(df, batch):
        seen.append(batch)
        if batch == 2 and seen.count(2) == 1:  # half of the batch is written, nothing is committed
            df.limit(5).withColumn("_batch", F.lit(batch).cast("long")).write.parquet(f"{table.path}/delta={batch}/part")
            raise RuntimeError("lost")
        done(df, batch)
        if batch == 3 and seen.count(3) == 1:  # the delta is written, the stream doesn't know yet
            raise RuntimeError("lost")

    table.apply = crash
    for _ in range(3):
        q = table.upsert_stream(stream_source(spark, feed, cols, max_files_per_trigger=1), table.path.rsplit("/", 1)[-1] + "-ck")
        try:
            q.awaitTermination()
        except Exception:
            pass
    assert seen == [0, 1, 2, 2, 3, 3]
    want = sorted(tuple(r) for r in upsert(base, spark.createDataFrame(rows, cols), ["id"], "seq").collect())
    assert sorted(tuple(r) for r in table.read().select("id", "seq", "v").collect()) == want
    assert table.compact() == 3
    table.vacuum()
    done(spark.createDataFrame([(0, 5, "older than what it holds"), (77, 1, "new")], cols), 4)
    assert sorted(tuple(r) for r in table.read().select("id", "seq", "v").collect()) == sorted([*want, (77, 1, "new")])


def test_keyed_table_needs_its_order_column(spark):
    with pytest.raises(ValueError):
        KeyedTable(spark, new_folder(spark, "t"), ["id"], "seq").create(spark.createDataFrame([(1,)], "id long"))


# -- K-1 -----------------------------------------------------------------------------

def test_cooldown_timers_equal_the_replay_and_forget(spark):
    rng = random.Random(3)
    rows = sorted((BASE + dt.timedelta(seconds=rng.randrange(3 * 86400)), i, rng.choice([0, 0, 1, 2, 3])) for i in range(1500))
    rows = [(k, i, t) for t, i, k in rows] + [(5, 9000, rows[3][0]), (5, 9001, rows[3][0])]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[2]), "user_id long, event_id long, ts timestamp_ntz")
    last = spark.createDataFrame([(99, 9999, BASE + dt.timedelta(days=9))], df.schema)
    parts = [df.where((F.col("ts") >= BASE + dt.timedelta(days=d)) & (F.col("ts") < BASE + dt.timedelta(days=d + 1))) for d in range(3)]
    feed = write_in_turn(spark, new_folder(spark, "feed"), [*parts, last])
    stream = S.cooldown_timers(stream_source(spark, feed, df.schema, max_files_per_trigger=1), "user_id", "ts", "event_id")
    query, got = S.run_to_files(stream, "alerts")
    want = {(r["user_id"], r["event_id"]) for r in A.cooldown_replay(df.union(last), "user_id", "ts", "event_id").collect()}
    assert {(r["user_id"], r["event_id"]) for r in got.collect()} == want
    # the closing row moved the watermark on: only its own key is still held
    held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) > 1 and held[-1] <= 4


def test_cooldown_live_expires(spark):
    folder, ck, out = new_folder(spark, "live"), checkpoint_subdir(spark, "live-" + str(time.time_ns())), new_folder(spark, "out")
    schema = "user_id long, event_id long"

    def run(rows):
        write_in_turn(spark, folder, [spark.createDataFrame(rows, schema)])
        return S.run_to_files(S.cooldown_live(stream_source(spark, folder, schema), "user_id", "event_id", 8), "live", out, ck, once=True)[1]

    run([(1, 1), (1, 2), (2, 3)])
    first = time.time()
    got = run([(3, 4)]) if time.time() - first > 7 else run([(1, 4), (3, 5)])
    time.sleep(max(0.0, 9 - (time.time() - first)))
    got = run([(1, 6)])
    rows = {tuple(r) for r in got.collect()}
    assert {(1, 1), (2, 3), (1, 6)} <= rows and (1, 2) not in rows


# -- K-7 -----------------------------------------------------------------------------

def test_late_stream_keeps_every_row(spark):
    rng = random.Random(9)
    rows = [(rng.choice([0, 0, 1, 2]), i, None if rng.random() < 0.02 else BASE + dt.timedelta(seconds=60 * i - rng.choice([0, 0, 900, 7000, 200000]))) for i in range(900)]
    df = spark.createDataFrame(rows, "user_id long, arrival long, ts timestamp_ntz")
    feed = write_in_turn(spark, new_folder(spark, "feed"), [df.where(f"arrival div 300 = {k}") for k in range(3)])
    out = S.run_to_files(S.late_stream(stream_source(spark, feed, df.schema, max_files_per_trigger=1), "user_id", "arrival", "ts"), "late")[1]
    got = {r["arrival"]: r for r in out.collect()}
    assert len(got) == len(rows)
    seen: dict = {}
    for k, i, t in rows:
        late = 0.0 if t is None or k not in seen else max(0.0, (seen[k] - t).total_seconds())
        assert got[i]["lateness_s"] == late
        if t is not None:
            seen[k] = max(seen.get(k, t), t)
    bands = {r["band"]: r["n"] for r in E.late_report(df.where("ts IS NOT NULL"), "user_id", "arrival", "ts").collect()}
    live = {r["band"]: r["count"] for r in out.where("ts IS NOT NULL").groupBy("band").count().collect()}
    assert bands == live and len(live) == 4


# -- G-10 ----------------------------------------------------------------------------

def test_payment_stream_equals_the_batch(spark):
    rng = random.Random(5)
    orders = [(k, 10.0 * k, BASE + dt.timedelta(minutes=20 * k)) for k in range(1, 60)]
    orders += [(200, 50.0, BASE + dt.timedelta(hours=6))]  # comes after its evidence, in time
    orders += [(300, 50.0, BASE + dt.timedelta(days=4))]  # comes too late
    evidence = [(i, rng.choice([*range(1, 80), 200, None]), 0.0, BASE + dt.timedelta(minutes=30 * i)) for i in range(60)]
    evidence = [(i, k, (k or 1) * rng.choice([10.0, 10.0, 11.0]), t) for i, k, _, t in evidence] + [(80, 300, 50.0, BASE), (81, 200, 50.0, BASE)]
    od = spark.createDataFrame([*orders, (None, None, BASE + dt.timedelta(days=400))], "o_id long, due double, at timestamp_ntz")
    ev = spark.createDataFrame([*evidence, (-1, None, None, BASE + dt.timedelta(days=400))], "evidence_id long, ref long, amount double, ts timestamp_ntz")
    cut = BASE + dt.timedelta(hours=12)
    # evidence comes in its order; orders in three files, one of them after all evidence
    ef = write_in_turn(spark, new_folder(spark, "ev"), [ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)])
    of = write_in_turn(spark, new_folder(spark, "od"), [od.where(F.col("at") < cut), od.where((F.col("at") >= cut) & F.col("o_id").isNotNull()), od.where("o_id IS NULL")])
    stream = S.payment_match_stream(stream_source(spark, ef, ev.schema, max_files_per_trigger=1), stream_source(spark, of, od.schema, max_files_per_trigger=1),
                                    "ref", "amount", "o_id", "due", "ts", "at", watermark="12 hours")
    got = sorted((tuple(r) for r in S.run_to_files(stream, "pay")[1].where("evidence_id >= 0").collect()), key=str)
    known = od.where(F.col("o_id").isNotNull() & (F.col("o_id") != 300))
    want = L.payment_match(ev.where("evidence_id >= 0"), known, "ref", "amount", "o_id", "due").select("evidence_id", "ref", "amount", "order_amount", "status")
    firsts: dict = {}
    for r in want.collect():
        firsts.setdefault(r["status"], 0)
        firsts[r["status"]] += 1
    assert set(firsts) == {"unknown_order", "duplicate", "amount_mismatch", "matched"}
    assert got == sorted((tuple(r) for r in want.collect()), key=str)


def test_staged(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a long, b string")
    assert sorted(tuple(r) for r in staged(df, "x").collect()) == [(1, None), (2, "b")]

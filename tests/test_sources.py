"""Readers and writers: posts JSON, chat text, sitemap XML, format dispatch,
CSV export, upsert, schema drift (A-3 .. A-10, E-12)."""

import json
import os

from pyspark.sql import functions as F

from tessera.operators import conversation as C, quality as Q
from tessera.sources import files


def _posts_file(folder, posts):
    path = os.path.join(folder, "posts.json")
    with open(path, "w") as f:
        json.dump(posts, f)
    return path


def test_read_posts_groups_array_or_scalar(spark, tmp_dir):
    posts = [
        {"title": "First", "summary": "s1", "groups": ["recent", "notes"], "content": ["a"], "read": "6m"},
        {"title": "Second", "summary": "s2", "groups": "data notes", "content": ["b"]},
        {"title": "Third", "summary": "s3"},
    ]
    df = files.read_posts(spark, _posts_file(tmp_dir, posts)).orderBy("pos")
    got = [(r["title"], r["groups"]) for r in df.collect()]
    assert got == [("First", ["recent", "notes"]), ("Second", ["data notes"]), ("Third", ["recent"])]


def test_read_posts_fallback_when_empty(spark, tmp_dir):
    fallback = spark.createDataFrame([("Static", "kept")], "title string, summary string")
    df = files.read_posts(spark, _posts_file(tmp_dir, []), fallback=fallback)
    assert [r["title"] for r in df.collect()] == ["Static"]


def test_export_posts_keeps_order(spark, tmp_dir):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "pos long, title string")
    out = os.path.join(tmp_dir, "out")
    files.export_posts(df.repartition(3), out)
    back = spark.read.json(out).orderBy("pos")
    assert [r["title"] for r in back.collect()] == ["a", "b", "c"]


def test_chat_lines_roundtrip(spark, tmp_dir):
    text = ("2024-01-01 08:00 - ann: hello\nsecond line\n"
            "2024-01-01 08:03 - Messages and calls are end-to-end encrypted\n"
            "2024-01-01 08:04 - bob: hi \U0001F600 see https://x.example.com/a\n<Media omitted>")
    path = os.path.join(tmp_dir, "chat.txt")
    with open(path, "w") as f:
        f.write(text)
    lines = files.read_chat_lines(spark, path)
    msgs = C.flag_system(C.rebuild_multiline(C.parse_chat(lines))).orderBy("msg_no").collect()
    assert [m["user"] for m in msgs] == ["ann", None, "bob"]
    assert msgs[0]["text"] == "hello\nsecond line"
    assert [m["is_system"] for m in msgs] == [False, True, False]
    feats = C.message_features(C.rebuild_multiline(C.parse_chat(lines))).orderBy("msg_no").collect()
    assert feats[2]["n_emojis"] == 1 and feats[2]["n_urls"] == 1 and feats[0]["n_words"] == 3


def test_sitemap_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("https://s.example.com/", 1.0), ("https://s.example.com/blog", 0.8)],
                               "loc string, priority double")
    out = os.path.join(tmp_dir, "sitemap")
    files.write_sitemap(df, out)
    back = files.read_sitemap(spark, out)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_read_any_dispatch(spark, tmp_dir):
    csv = os.path.join(tmp_dir, "a.csv")
    with open(csv, "w") as f:
        f.write("id,name\n1,x\n2,y\n")
    tsv = os.path.join(tmp_dir, "b.tsv")
    with open(tsv, "w") as f:
        f.write("id\tname\n1\tx\n")
    js = os.path.join(tmp_dir, "c.json")
    with open(js, "w") as f:
        f.write('{"id": 1}\n{"id": 2}\n')
    assert files.read_any(spark, csv).count() == 2
    assert files.read_any(spark, tsv).columns == ["id", "name"]
    assert files.read_any(spark, js).count() == 2
    import pytest
    with pytest.raises(ValueError):
        files.read_any(spark, os.path.join(tmp_dir, "d.xlsx"))


def test_export_csv_neutralises(spark, tmp_dir):
    df = spark.createDataFrame([(1, "=SUM(A1)"), (2, "plain")], "id int, v string")
    out = os.path.join(tmp_dir, "csv")
    files.export_csv(df, out)
    back = spark.read.option("header", True).csv(out).orderBy("id")
    assert [r["v"] for r in back.collect()] == ["'=SUM(A1)", "plain"]


def test_upsert_latest_change_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "b1", 1), (2, "b2", 2), (3, "c", 1)], "k int, v string, t int")
    got = sorted(tuple(r) for r in files.upsert(base, changes.select("k", "v", "t"), ["k"], "t")
                 .select("k", "v").collect())
    assert got == [(1, "a"), (2, "b2"), (3, "c")]


def test_schema_drift(spark):
    old = spark.createDataFrame([(1, "x")], "id int, name string")
    new = spark.createDataFrame([(1, 2.0)], "id long, score double")
    got = {r["column_name"]: r["change"] for r in Q.schema_drift(old, new).collect()}
    assert got == {"id": "retyped", "name": "removed", "score": "added"}


def test_audit_log_partition_pruning(spark, tmp_dir):
    import contextlib
    import io

    from tessera.operators.ledger import audit_trail, write_audit
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = os.path.join(tmp_dir, "audit")
    write_audit(ev, path, "ts")
    log = spark.read.parquet(path).filter(F.col("log_date") == F.lit("2024-01-05").cast("date"))
    got = audit_trail(log, "user_id", 7, "ts", "event_id")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        got.explain(mode="formatted")
    plan = buf.getvalue()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "EqualTo(user_id,7)" in plan
    exp = ev.filter((F.to_date("ts") == F.lit("2024-01-05").cast("date")) & (F.col("user_id") == 7)).count()
    assert got.count() == exp


def test_gate_log_appends_runs(spark, tmp_dir):
    from tessera.plans.registry import load_all
    gate = load_all()["quality_gate"].build(spark, "/root/testdata/sf0.001")
    path = os.path.join(tmp_dir, "gate_log")
    Q.log_gate(gate, path, "2024-03-01 06:00:00")
    Q.log_gate(gate, path, "2024-03-02 06:00:00")
    log = spark.read.parquet(path)
    assert log.count() == 10 and log.select("run_date").distinct().count() == 2
    assert log.filter(F.col("run_date") == F.lit("2024-03-02").cast("date")).count() == 5


def test_read_table_casts(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.csv")
    with open(path, "w") as f:
        f.write("iso_code,prevalence\nAAA,12.5\nBBB,n/a\nCCC,NaN\n")
    df = files.read_table(spark, path, "iso_code string, prevalence string", fmt="csv", casts={"prevalence": "double"},
                          header=True)
    assert [r["prevalence"] for r in df.orderBy("iso_code").collect()] == [12.5, None, None]


def test_posts_as_lines_are_numbered_over_files(spark, tmp_dir):
    out = os.path.join(tmp_dir, "lines")
    df = spark.range(5000).select((-F.col("id")).alias("pos"), F.concat(F.lit("t"), "id").alias("title"), F.array(F.lit("g")).alias("groups"))
    files.export_posts(df.repartition(6), out)
    got = files.read_posts(spark, out).select("pos", "title", "groups").orderBy("pos").collect()
    assert [(r["pos"], r["title"]) for r in got] == [(i, f"t{4999 - i}") for i in range(5000)]
    assert all(r["groups"] == ["g"] for r in got)


def test_read_any_takes_arrays_over_several_lines(spark, tmp_dir):
    arr, lines, empty = (os.path.join(tmp_dir, n) for n in ("a.json", "b.json", "c.json"))
    with open(arr, "w") as f:
        f.write('\n  [\n {"id": 1,\n "name": "a"},\n {"id": 2, "name": null}\n]\n')
    with open(lines, "w") as f:
        f.write('{"id": 1, "name": "a"}\n{"id": 2}\n')
    open(empty, "w").close()
    want = {(1, "a"), (2, None)}
    assert {(r["id"], r["name"]) for r in files.read_any(spark, arr).collect()} == want
    assert {(r["id"], r["name"]) for r in files.read_any(spark, lines).collect()} == want
    assert files.read_any(spark, empty, schema="id long, name string").count() == 0

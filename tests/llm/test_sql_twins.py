"""The SQL of op6 on vectors that have links, and of op10 on odd texts, gives the operators' rows."""

import duckdb
import numpy as np

from tessera.llm.queries import ORACLE_SQL, QUERIES


def test_near_duplicate_vectors(spark, tmp_dir):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in (centre[i % 6] + rng.normal(scale=[0.1, 0.25, 0.5][i % 3], size=16)).astype(np.float32)], [0, 1, None][i % 7 % 3]) for i in range(150)]
    rows += [(150, None, 0), (151, [0.0] * 16, 0), (152, rows[0][1], rows[0][2]), (153, [float("nan")] * 16, 1), (154, [*rows[1][1][:15], None], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_dir}/embeddings.parquet")
    got = QUERIES["op6_embedding_near_dedup"](spark, tmp_dir).select("vec_id", "n_links", "component_id", "kept").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_dir}/embeddings.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["op6_embedding_near_dedup"]).fetchall()
    assert sum(w[1] for w in want) > 50
    assert sorted(map(tuple, got)) == sorted(want)


def test_contaminated_documents(spark, tmp_dir):
    item = " ".join(f"w{i}" for i in range(20))
    items = [(1, item), (12, "Two Words"), (3, None), (4, ""), (5, item.upper()), (20, "\u00c9t\u00e9 \u00e9t\u00e9")]
    docs = [(1, "a " + item + " b"), (2, "x two-WORDS y " * 3), (3, None), (4, ""), (5, "w0 w1 w2"), (6, "pad " * 900 + "two words"), (7, "\u00c9t\u00e9 \u00e9t\u00e9"),
            (8, " ".join(item.split()[:12])), (9, "\u00e9t\u00e9 \u00e9t\u00e9")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_dir}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_dir}/{t}.parquet/*.parquet')")
    cur = con.execute(ORACLE_SQL["op10_benchmark_decontamination"])
    names = [c[0] for c in cur.description]
    got = QUERIES["op10_benchmark_decontamination"](spark, tmp_dir)
    assert sorted(got.columns) == sorted(names)
    want = sorted(cur.fetchall())
    assert sorted(map(tuple, got.select(*names).collect())) == want
    assert [w[0] for w in want if w[-1]] == [1, 2, 7]  # the rule worked out by hand

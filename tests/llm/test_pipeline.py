"""The corpus pipeline, stage by stage, against plain Python on what the stage before kept."""

import hashlib

import pytest

import corpus_pipeline
from tessera.llm import quality, suffix_dedup
from tests.llm import brute
from tests.llm.test_operators import WORDS, labelled

NAMES = ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labelled documents, near and exact copies, a passage that repeats, and benchmark items inside some documents."""
    path = f"file://{tmp_path_factory.mktemp('corpus')}"
    docs, labels = labelled(spark, 260)
    rows = [tuple(r) for r in docs.collect()]
    bad = {i for i, q, t in labels if t or not q}
    clean = [r for r in rows if r[0] not in bad]
    n = len(rows)
    passage = " ".join(WORDS[k * 7 % len(WORDS)] + str(k) for k in range(60))
    item = " ".join(clean[1][1].split()[5:19])
    more = [clean[0][1], clean[0][1] + " more", clean[2][1] + " " + passage, passage + " " + clean[3][1], clean[4][1] + " " + item + " end", None, ""]
    rows += [(n + k, t, "en", "h1", 0) for k, t in enumerate(more)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, "not in any text of these documents at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs
        if name == NAMES[-1]:
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == NAMES[0]:
            labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
            gone = before.keys() - after.keys()
            wrong = [i for i, r in labels.items() if (i in gone) != bool(r["toxic"] or not r["quality"])]
            assert len(wrong) <= 0.03 * len(labels)
        elif name == NAMES[1]:
            want = brute.jaccard(list(before.items()))
            assert after == {i: before[i] for i, (_, c) in want.items() if c == i}
        elif name == NAMES[2]:
            assert after.keys() == before.keys()
            ids = list(before)
            for i, (size, removed, _, digest) in zip(ids, brute.repeats([before[i] for i in ids], suffix_dedup.LENGTH)):
                kept = (after[i] or "").encode()
                assert len(kept) == size - removed and hashlib.sha256(kept).hexdigest() == digest
                assert before[i] is not None or after[i] is None
            assert any(after[i] != before[i] for i in ids)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)
        elif name == NAMES[3]:
            bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            want = brute.contamination(list(before.items()), bench)
            assert after == {i: before[i] for i in before if not want[i][-1]} and len(after) < len(before)
        before = after
    tok = brute.tokenizer("byte_bpe_50k.json")
    packed = {}
    for r in out[NAMES[-1]].collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == {i: len(brute.ids(tok, t)) + 1 for i, t in before.items()}


def test_run_applies_all_stages(spark, folder):
    got = sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())
    want = sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in spark.read.parquet(f"{folder}/{NAMES[-1]}").collect())
    assert got == want


def test_rejections_take_effect(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rejected = {r["doc_id"] for r in quality.classify(docs, labels).where("rejected").collect()}
    assert rejected and rejected == {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in spark.read.parquet(f"{folder}/{NAMES[0]}").collect()}

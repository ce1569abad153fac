"""Stages 2 and 3 of the corpus pipeline on repeated rows, shared ids and null ids."""

import pytest

import corpus_pipeline
from tessera.llm import ngram_jaccard
from tessera.llm.common import saved
from tests.llm.test_operators import SCHEMA, corpus

STAGES = dict(corpus_pipeline.STAGES)


def text(name: str, words: int = 60) -> str:
    return " ".join(f"{name}{i * i}" for i in range(words))


def test_repeated_rows_keep_their_text(spark):
    """A clean document that was loaded twice stays once, with its whole text."""
    a, b, c, d = (text(x) for x in "abcd")
    rows = [(1, a), (1, a), (2, a + " end"), (None, b), (None, b), (None, b + " end"), (None, c), (4, c), (4, c + " end"), (4, c + " end"), (4, d),
            (6, None), (6, None), (7, ""), (None, ""), (None, "")]
    assert all(len(x) >= 200 for x in (a, b, c, d))
    df = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)
    one = saved(STAGES["ngram_jaccard_join"](spark, df, ""), "one")
    assert one.columns == df.columns
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in one.collect())
    assert [(i, t.removesuffix(" end")) for i, t in kept] == [("1", a), ("4", c), ("4", d), ("6", ""), ("7", ""), ("None", ""), ("None", ""), ("None", b)]
    assert ("1", a) in kept
    cut = STAGES["suffix_array_dedup"](spark, one, "")
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in cut.collect()) == kept


@pytest.mark.parametrize("chunk", [2048, 4])
def test_a_table_loaded_twice_gives_what_it_gives_once(spark, chunk):
    df = spark.createDataFrame(corpus(), SCHEMA)
    once = ngram_jaccard.representatives(df, chunk=chunk)
    twice = ngram_jaccard.representatives(df.unionAll(df).repartition(3), chunk=chunk)
    got = sorted(map(str, twice.collect()))
    assert got == sorted(map(str, once.collect())) == sorted(map(str, ngram_jaccard.keep_one(df, chunk=chunk).collect()))
    assert ngram_jaccard.representatives(df.limit(0)).count() == 0

"""Registered queries of the corpus operators, one per operator, each over its
whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (decontamination, embedding_dedup, hard_negatives, language_id, lm_scoring, ngram_jaccard, packing, quality, sharding,
                         suffix_dedup, token_counts, token_files, whitening)
from tessera.llm.common import documents
from tessera.sources.tables import load


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(documents(spark, sf_dir)).drop("row_key")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 16)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), load(spark, sf_dir, "labels")).drop("row_key")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op7_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    moved = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("vec_id") % 100 == 0)


def op12_class_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir), lambda doc_id: F.crc32(F.col(doc_id).cast("string")) % 7 == 2)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_stratified_sharding": op4_stratified_sharding,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_huffman_token_files": op7_huffman_token_files,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_class_lm_scoring": op12_class_lm_scoring,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        u AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS norm FROM v),
        link AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
          WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
        reach AS (
          SELECT vec_id, vec_id AS other FROM embeddings
          UNION
          SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other)
        SELECT r.vec_id, coalesce(l.n, 0) AS n_links, r.component_id, r.vec_id = r.component_id AS kept
        FROM (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) r
        LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = r.vec_id""",
    "op10_benchmark_decontamination": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        b AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
        item AS (
          SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        word AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        gram AS (
          SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
          FROM word JOIN (SELECT DISTINCT size FROM item) s ON i + size - 1 <= len(w)),
        found AS (SELECT doc_id, i, size, item_id FROM gram JOIN item USING (size, g)),
        hit AS (
          SELECT doc_id, count(DISTINCT pos) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
        items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_hard_negatives": """
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (
          SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
          SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        n AS (
          SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
          FROM p JOIN s USING (anchor_id)
          WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}

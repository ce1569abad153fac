"""Chunking and vector retrieval over ``documents``, ``embeddings`` and
``benchmark``.

Binding (chosen here): the query batch is the centroid of every label of
``embeddings`` (so it is derived from the table); the library is every
vector; the external evidence source tags vectors that share the query's
label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators.conversation import STOP_WORDS
from tessera.plans import bindings as B
from tessera.plans.common import rounded, tables
from tessera.operators.vector_index import VectorIndex
from tessera.plans.registry import register

W = B.with_ctes
K = 5
CHUNK, OVERLAP = 500, 100


@register("chunk_documents", ops=("H-6",), sql=f"""
SELECT doc_id, CAST(start // {CHUNK - OVERLAP} AS INTEGER) AS chunk_no, CAST(start AS INTEGER) AS start,
       substring(text, start + 1, {CHUNK}) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, length(text), {CHUNK - OVERLAP})) AS start FROM documents)""")
def chunk_documents(spark, sf_dir):
    return R.chunk_documents(tables(spark, sf_dir).documents, CHUNK, OVERLAP)


def _queries(spark, sf_dir):
    e = tables(spark, sf_dir).embeddings
    return R.centroids(e, "label").withColumnRenamed("label", "query_id")


def _hits(spark, sf_dir):
    e = tables(spark, sf_dir).embeddings
    return R.similar_top_k(_queries(spark, sf_dir), e, K, query_id="query_id")


TOPK_CTE = f"""el AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ex AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM el),
cen AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS x FROM ex GROUP BY label, i)
        GROUP BY label),
sc AS (SELECT cen.query_id, el.vec_id,
              round(list_dot_product(cen.q, el.v) / (sqrt(list_dot_product(cen.q, cen.q)) * sqrt(list_dot_product(el.v, el.v))), 12) AS score
       FROM cen, el),
hits AS (SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank,
                               vec_id, score FROM sc) WHERE rank <= {K})"""


@register("similar_top_k", ops=("H-7",), sql=W(TOPK_CTE) + "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM hits")
def similar_top_k(spark, sf_dir):
    return _hits(spark, sf_dir).withColumn("query_id", F.col("query_id").cast("int"))


@register("similar_top_k_index", ops=("H-7",), sql=W(TOPK_CTE) + "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM hits")
def similar_top_k_index(spark, sf_dir):
    """The same search through an index of groups around pivots."""
    index = VectorIndex(tables(spark, sf_dir).embeddings)
    return index.search(_queries(spark, sf_dir), K)[0].withColumn("query_id", F.col("query_id").cast("int"))


@register("rank_evidence", ops=("H-8",), sql=W(TOPK_CTE) + f""",
loc AS (SELECT query_id, vec_id, max(score) AS l FROM hits GROUP BY 1, 2),
ext AS (SELECT label AS query_id, vec_id, 1.0 AS e FROM embeddings),
j AS (SELECT coalesce(loc.query_id, ext.query_id) AS query_id, coalesce(loc.vec_id, ext.vec_id) AS vec_id,
             0.7 * coalesce(loc.l, 0.0) + 0.3 * coalesce(ext.e, 0.0) AS combined,
             (loc.l IS NOT NULL)::INT + (ext.e IS NOT NULL)::INT AS sources
      FROM loc FULL JOIN ext ON loc.query_id = ext.query_id AND loc.vec_id = ext.vec_id)
SELECT query_id, vec_id, round(combined, 6) AS combined, sources, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, vec_id) AS rank FROM j) WHERE rank <= {K}""")
def rank_evidence(spark, sf_dir):
    hits = _hits(spark, sf_dir).select(F.col("query_id").cast("int").alias("query_id"), "vec_id", "score")
    ext = tables(spark, sf_dir).embeddings.select(F.col("label").alias("query_id"), "vec_id",
                                                  F.lit(1.0).alias("score"))
    r = R.rank_evidence(hits, ext, ["query_id"], "vec_id", 0.7, 0.3, k=K)
    return rounded(r.select("query_id", "vec_id", "combined", "sources", "rank"))


@register("citations", ops=("H-9",), sql=W(TOPK_CTE) + """
SELECT query_id, string_agg('[' || CAST(rank AS VARCHAR) || '] vector ' || CAST(vec_id AS VARCHAR), '; ' ORDER BY rank) AS "references",
       count(*) AS n_sources
FROM hits GROUP BY query_id""")
def citations(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("query_id", F.col("query_id").cast("int"))
    return R.citations(hits, ["query_id"], "vec_id", "rank",
                       label=F.concat(F.lit("vector "), F.col("vec_id").cast("string")))


SYN_SQL = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(R.SYNONYMS.items())) + " ELSE t END"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))) + "]"


@register("optimize_query", ops=("H-11",), sql=f"""
SELECT item_id, array_to_string(list_transform(list_filter(
  list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''),
  lambda t: NOT list_contains({STOP_SQL}, t)), lambda t: {SYN_SQL}), ' ') AS query
FROM benchmark""")
def optimize_query(spark, sf_dir):
    b = tables(spark, sf_dir).benchmark
    return R.optimize_query(b).select("item_id", "query")


@register("library_catalog", ops=("H-12",), sql="""
SELECT source, count(*) AS n_docs, list_sort(list_distinct(list(lang))) AS languages, sum(n_chars) AS total_chars
FROM documents GROUP BY source""")
def library_catalog(spark, sf_dir):
    return R.library_catalog(tables(spark, sf_dir).documents, "source", "lang", "n_chars")

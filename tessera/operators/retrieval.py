"""Chunking and vector retrieval (H-6 .. H-9, H-11, H-12).

Exact top-k similarity search for any number of queries: the library is packed
into tiles where it lies (one Arrow batch each), the queries into blocks of
about ``QUERY_BLOCK``; every tile meets every block in an equi-join on the block
number, one matrix product scores the pair, and only the best k of each query
leave it. Nothing is fetched while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.conversation import STOP_WORDS, tokens
from tessera.session import ship_library


def chunk_documents(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Fixed character windows of ``size`` advancing by ``size - overlap``
    over the whole text (H-6); the last chunk may be shorter. Empty text
    gives no chunk."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = F.char_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    # cut first, so that no row carries the whole text
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(F.col(text), s + 1, F.lit(size)).alias("chunk")))
    return (docs.select(id_col, F.posexplode(cut).alias("chunk_no", "c"))
            .select(id_col, "chunk_no", "c.start", "c.chunk"))


def centroids(vectors: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per group: element-wise sums with a hash aggregate over
    exploded elements, then one ordered array per group (its length is the
    vector dimension)."""
    e = vectors.select(group, F.posexplode(vec).alias("i", "x"))
    m = e.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vec))


#: Queries of a block, and decimals to which scores are compared (closer ones tie).
QUERY_BLOCK = 256
SCORE_DECIMALS = 12

TILE = "ids array<long>, dim int, data binary"
FOUND = "query_idx long, vec_id long, score double"


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Unit rows of a vector column, a mask of the rows that have one, and the
    length. Vectors that are null, zero, of another length than the first, or
    hold nulls have no direction."""
    rows = column.to_pylist()
    dim = next((len(r) for r in rows if r), 0)
    good = np.array([r is not None and len(r) == dim and dim > 0 and None not in r for r in rows], bool)
    x = np.array([r if g else [0.0] * dim for r, g in zip(rows, good)], float).reshape(len(rows), dim)
    norm = np.sqrt((x * x).sum(axis=1))
    good &= norm > 0
    return x / np.where(good, norm, 1.0)[:, None], good, dim


def _pack(table) -> pa.RecordBatch:
    x, good, dim = _matrix(table.column("vec").combine_chunks() if isinstance(table, pa.Table) else table.column("vec"))
    x[~good] = np.nan
    return pa.RecordBatch.from_arrays(
        [pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([dim], pa.int32()), pa.array([x.tobytes()], pa.binary())],
        names=["ids", "dim", "data"])


def _score(k: int):
    def fn(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lib = np.frombuffer(r["data"], float).reshape(-1, r["dim"]) if r["dim"] else np.zeros((len(r["ids"]), 0))
                qs = np.frombuffer(r["q_data"], float).reshape(-1, r["q_dim"]) if r["q_dim"] else np.zeros((len(r["q_ids"]), 0))
                same = r["dim"] == r["q_dim"] and r["dim"] > 0
                scores = np.round(qs @ lib.T, SCORE_DECIMALS) if same else np.full((len(qs), len(lib)), np.nan)
                ids = np.array(r["ids"], np.int64)
                for q, s in zip(r["q_ids"], scores):
                    top = np.lexsort((ids, np.where(np.isnan(s), np.inf, -s)))[:k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(top), q)), pa.array(ids[top]), pa.array(s[top], from_pandas=True)], names=["query_idx", "vec_id", "score"])
    return fn


def similar_top_k(queries: DataFrame, library: DataFrame, k: int, query_id: str = "query_id",
                  vec: str = "embedding", lib_id: str = "vec_id", decimals: int | None = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top-k of each query over the whole library (H-7), for any
    number of queries with distinct integer ids.

    Output ``(query_id, rank, vec_id, score)``, ranked on full scores; scores
    equal to ``SCORE_DECIMALS`` decimals tie and go by ``vec_id``; scores are
    rounded to ``decimals`` for output only. Vectors without a direction score
    null and come last."""
    ship_library(library.sparkSession)
    doubles = F.col(vec).cast("array<double>").alias("vec")
    qs = queries.select(F.col(query_id).cast("long").alias("id"), doubles)
    n_blocks = qs.select(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.lit(1)).cast("int")).scalar()
    dealt = qs.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))
    blocks = dealt.groupBy("block").applyInArrow(
        lambda key, t: pa.Table.from_batches([_pack(t)]).append_column("block", pa.array([key[0].as_py()], pa.int32())), TILE + ", block int")
    blocks = blocks.select("block", F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data"))
    tiles = library.select(F.col(lib_id).cast("long").alias("id"), doubles).mapInArrow(
        lambda batches: (_pack(b) for b in batches if b.num_rows), TILE)
    tiles = tiles.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    cand = tiles.join(blocks, "block").drop("block").mapInArrow(_score(k), FOUND)
    w = Window.partitionBy("query_idx").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    score = F.col("score") if decimals is None else F.round("score", decimals).alias("score")
    return top.select(F.col("query_idx").cast(dict(queries.dtypes)[query_id]).alias(query_id), "rank", F.col("vec_id").alias(lib_id), score)


def rank_evidence(local: DataFrame, external: DataFrame, key: Sequence[str], item: str,
                  w_local: float = 0.7, w_external: float = 0.3, k: int = 10) -> DataFrame:
    """Merge two evidence sources and rank (H-8): both have ``(key..., item,
    score)``; combined score = weighted sum (a missing side counts 0), one
    row per item (duplicates merged by a grouped max), top k per key."""
    from tessera.operators.ranking import top_k_per_group
    a = local.groupBy(*key, item).agg(F.max("score").alias("_l"))
    b = external.groupBy(*key, item).agg(F.max("score").alias("_e"))
    j = a.join(b, list(key) + [item], "full")
    s = j.withColumn("combined", F.lit(w_local) * F.coalesce(F.col("_l"), F.lit(0.0))
                     + F.lit(w_external) * F.coalesce(F.col("_e"), F.lit(0.0)))
    s = s.withColumn("sources", (F.col("_l").isNotNull().cast("int") + F.col("_e").isNotNull().cast("int")))
    # salted two-stage top-k: one query can have a large share of all evidence rows
    return top_k_per_group(s.drop("_l", "_e"), list(key), "combined", k, tiebreak=[item], rank_name="rank")


def citations(results: DataFrame, key: Sequence[str], source: str, rank: str = "rank",
              label: Column | None = None) -> DataFrame:
    """Reference list per key (H-9): distinct sources in rank order,
    numbered, joined as ``[1] ...; [2] ...``. ``results`` is already a
    top-k result, so the list per key is bounded."""
    lab = label if label is not None else F.col(source).cast("string")
    first = results.groupBy(*key, source).agg(F.min(rank).alias("_r"), F.first(lab).alias("_lab"))
    w = Window.partitionBy(*key).orderBy("_r", source)
    numbered = first.withColumn("citation_no", F.row_number().over(w))
    return numbered.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation_no", "_lab"))),
                                 lambda x: F.concat(F.lit("["), x["citation_no"].cast("string"), F.lit("] "), x["_lab"])),
                     "; ").alias("references"),
        F.count(F.lit(1)).alias("n_sources"))


# Query-rewrite synonyms (term -> replacement).
SYNONYMS = {
    "colour": "color",
    "favourite": "favorite",
    "cheap": "inexpensive",
    "buy": "purchase",
    "photo": "image",
}


def optimize_query(df: DataFrame, text: str = "text", stop_words: Sequence[str] = STOP_WORDS,
                   synonyms: dict[str, str] = SYNONYMS, name: str = "query") -> DataFrame:
    """Query rewriting (H-11): lower-case tokens, stop words dropped,
    synonyms replaced, joined by single spaces. The stop list and synonym
    map are literals in one projection (no join, no explode)."""
    stop = F.array(*[F.lit(w) for w in sorted(set(stop_words))])
    syn = F.create_map(*[F.lit(x) for kv in sorted(synonyms.items()) for x in kv])
    toks = F.filter(tokens(F.col(text)), lambda t: ~F.array_contains(stop, t))
    toks = F.transform(toks, lambda t: F.coalesce(F.element_at(syn, t), t))
    return df.withColumn(name, F.array_join(toks, " "))


def library_catalog(docs: DataFrame, library: str, lang: str, n_chars: str) -> DataFrame:
    """Libraries with document counts, languages and size (H-12)."""
    return docs.groupBy(library).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.array_sort(F.collect_set(lang)).alias("languages"),
        F.sum(n_chars).alias("total_chars"))

"""Exact vector search that skips what can't be near (H-7).

Vectors lie in groups around pivots, packed into tiles in the order of their angle
to their pivot. Angles obey the triangle inequality: with t the angle of a
query to the pivot, no vector of a tile whose angles span [low, high] is
nearer than max(low - t, t - high, 0). A tile is skipped for a query once the cosine of
that bound is below the k-th best score known to it, first from the pivots,
which are library vectors themselves, then from what the task has scored. What is
skipped can't enter the result, so the ids equal those of a full scan.

The pivots (a bounded sample by hash of the id) and the queries of one pass (a
bounded number) are broadcast; tiles are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import SCORE_DECIMALS, _matrix
from tessera.session import ship_library
from tessera.sources.stage import new_folder, staged

PIVOTS = 256
TILE_ROWS = 512
QUERY_PASS = 2048
#: Room for rounding in angles and scores.
SLACK = 1e-9

PLACED = "grp int, angle double, id long, data binary"
TILES = "grp int, low double, high double, ids array<long>, data binary"
FOUND = "query_idx long, vec_id long, score double"


class VectorIndex:
    """A packed library; ``search`` may be called any number of times."""

    def __init__(self, library: DataFrame, lib_id: str = "vec_id", vec: str = "embedding", pivots: int = PIVOTS):
        spark = library.sparkSession
        ship_library(spark)
        rows = library.select(F.col(lib_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
        length = rows.where(F.size("vec") > 0).groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        self.dim = dim = length["dim"] if length else 0
        sample = rows.where(F.size("vec") == dim).orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow() if dim else None
        if sample is not None and sample.num_rows:
            x, good, _ = _matrix(sample.column("vec").combine_chunks())
            self.pivots = x[good]
        else:
            self.pivots = np.zeros((0, dim))
        shared = spark.sparkContext.broadcast(self.pivots)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                column = batch.column("vec")
                same = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1)) == dim
                x = np.zeros((batch.num_rows, dim))
                good = np.zeros(batch.num_rows, bool)
                if same.any() and len(centres):
                    x[same], good[same], _ = _matrix(column.filter(pa.array(same)))
                grp, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
                if good.any():
                    cos = x[good] @ centres.T
                    grp[good] = cos.argmax(axis=1)
                    angle[good] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(angle), batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["grp", "angle", "id", "data"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grp, angle = batch.column("grp").to_numpy(), batch.column("angle").to_numpy()
                cuts = np.flatnonzero(np.append(True, grp[1:] != grp[:-1])) if len(grp) else []
                for a, b in zip(cuts, [*cuts[1:], len(grp)]):
                    for k in range(a, b, TILE_ROWS):
                        e = min(b, k + TILE_ROWS)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([grp[k]], pa.int32()), pa.array([angle[k]]), pa.array([angle[e - 1]]), pa.array([batch.column("id").slice(k, e - k).to_pylist()], pa.list_(pa.int64())),
                             pa.array([b"".join(batch.column("data").slice(k, e - k).to_pylist())], pa.binary())], names=["grp", "low", "high", "ids", "data"])

        placed = rows.mapInArrow(place, PLACED)
        # ranges over group, angle and id: a group that holds most vectors still spreads over tasks
        ordered = placed.repartitionByRange("grp", "angle", "id").sortWithinPartitions("grp", "angle", "id")
        self.tiles = staged(ordered.mapInArrow(pack, TILES), "vector-tiles")

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", vec: str = "embedding", lib_id: str = "vec_id",
               decimals: int | None = 6, per_pass: int = QUERY_PASS) -> tuple[DataFrame, float]:
        """``(query_id, rank, vec_id, score)`` as ``similar_top_k`` gives it, for queries with
        distinct ids, and the share of (query, tile) pairs that were skipped."""
        spark = queries.sparkSession
        qs = staged(queries.select(F.col(query_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")), "queries")
        passes = -(-qs.count() // per_pass)
        path = new_folder(spark, "found")
        spark.createDataFrame([], FOUND).write.parquet(path)
        for n in range(passes):
            part = qs.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == n).orderBy("id").toArrow()
            if part.num_rows:
                shared = spark.sparkContext.broadcast(_Queries(part, self.pivots, self.dim, k))
                self.tiles.mapInArrow(_scan(shared), FOUND).write.mode("append").parquet(path)
                shared.destroy()
        found = spark.read.schema(FOUND).parquet(path)
        stats = found.where("query_idx IS NULL").agg(F.sum("vec_id").alias("scored"), F.sum("score").alias("pairs")).first()
        best = Window.partitionBy("query_idx").orderBy(F.col("score").desc_nulls_last(), "vec_id")
        top = found.where("query_idx IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        score = F.col("score") if decimals is None else F.round("score", decimals).alias("score")
        rows = top.select(F.col("query_idx").cast(dict(queries.dtypes)[query_id]).alias(query_id), "rank", F.col("vec_id").alias(lib_id), score)
        return rows, 1 - (stats["scored"] or 0) / stats["pairs"] if stats["pairs"] else 0.0


class _Queries:
    """The queries of one pass, their angles to the pivots, and the k-th best pivot score of each."""

    def __init__(self, table: pa.Table, pivots: np.ndarray, dim: int, k: int):
        self.k, self.dim = k, dim
        self.id = table.column("id").to_numpy()
        column = table.column("vec").combine_chunks()
        same = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1)) == dim
        self.x = np.zeros((len(self.id), dim))
        self.good = np.zeros(len(self.id), bool)
        if dim and same.any():
            self.x[same], self.good[same], _ = _matrix(column.filter(pa.array(same)))
        cos = self.x @ pivots.T
        self.angle = np.arccos(np.clip(cos, -1, 1))
        self.bound = np.full(len(self.id), -np.inf)
        if cos.shape[1] >= k:
            self.bound = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k] - SLACK


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        n, k = len(q.id), q.k
        good = np.flatnonzero(q.good)
        score, ident = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        bound = q.bound.copy()
        every, blank = np.zeros(0, np.int64), np.zeros(0, np.int64)
        scored = pairs = 0
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.array(r["ids"], np.int64)
                every = np.sort(np.append(every, ids))[:k]
                if r["grp"] < 0:
                    blank = np.sort(np.append(blank, ids))[:k]
                    continue
                t = q.angle[good, r["grp"]]
                near = np.maximum(np.maximum(r["low"] - t, t - r["high"]), 0)
                on = good[np.cos(near) + SLACK >= bound[good]]
                pairs += len(good)
                scored += len(on)
                if not len(on):
                    continue
                s = np.round(q.x[on] @ np.frombuffer(r["data"], float).reshape(-1, q.dim).T, SCORE_DECIMALS)
                i, j = np.nonzero((s >= bound[on][:, None]) & (s >= score[on, -1][:, None]))
                touched = np.unique(i)
                h = on[touched]
                row = np.concatenate([np.searchsorted(touched, i), np.repeat(np.arange(len(h)), k)])
                value, name = np.concatenate([s[i, j], score[h].ravel()]), np.concatenate([ids[j], ident[h].ravel()])
                order = np.lexsort((name, -value, row))
                row, value, name = row[order], value[order], name[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < k
                score[h[row[keep]], place[keep]], ident[h[row[keep]], place[keep]] = value[keep], name[keep]
                bound[h] = np.maximum(bound[h], score[h, -1] - SLACK)
        held = np.isfinite(score)
        if every.size:
            bad = np.flatnonzero(~q.good)
            idx = np.concatenate([q.id[np.nonzero(held)[0]], np.repeat(q.id[good], len(blank)), np.repeat(q.id[bad], len(every))])
            vec = np.concatenate([ident[held], np.tile(blank, len(good)), np.tile(every, len(bad))])
            val = np.concatenate([score[held], np.full(len(good) * len(blank) + len(bad) * len(every), np.nan)])
            yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(vec), pa.array(val, from_pandas=True)], names=["query_idx", "vec_id", "score"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([scored]), pa.array([float(pairs)])], names=["query_idx", "vec_id", "score"])

    return run

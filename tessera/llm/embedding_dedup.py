"""Embedding near-dedup (operator 6): int8 quantised tile products.

Only vectors of one label (and length) are compared. Equal vectors fold into
one class first. The classes of a label are dealt to tiles of about ``TILE``
by hash; each pair of tiles is one task-sized cell. In a cell, all products of
the quantised unit vectors come from one integer-valued matrix product. With
x = s q + e for the scale s, the int8 vector q and the exact error e,

    |x.y - s t q.r| <= |s q| |f| + |t r| |e| + |e| |f|

by Cauchy-Schwarz (f: error of y = t r + f), so a pair whose product plus that
bound and a rounding allowance stays under the threshold cannot link. Only the
other pairs are computed in double precision and compared with the threshold.
A cell emits the number of links of each class and a spanning forest of its
links, never all pairs.

Edge cases: rows whose label is null, or whose vector is null, empty, zero or
holds null or non-finite components, link with nothing and keep themselves.
Vectors of different length never link. Repeated vectors (also repeated ids)
are separate rows that link with each other. Null ids: the row is its own
member, and a component's id is the smallest id that isn't null. An empty
table gives no rows. Only the named columns are read.

The work inside a label is quadratic, as the contract's exact comparison of
all rows of a label asks; a cell holds two tiles whatever the label's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import group_arrow, hash_id, saved
from tessera.llm.components import components, local_roots

THRESHOLD = 0.93
TILE = 1024
ROUNDING = 1e-9
EXACT_PAIRS = 1 << 16


class Quantised:
    """Unit vectors as int8 with their scales and exact error norms."""

    def __init__(self, x: np.ndarray):
        self.raw = x
        # divide by the largest component first, so that squares neither overflow nor vanish
        scaled = x / np.abs(x).max(axis=1, keepdims=True)
        self.unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.q = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        back = self.q * self.scale[:, None]
        self.size = np.sqrt((back * back).sum(axis=1))
        self.error = np.sqrt(((self.unit - back) ** 2).sum(axis=1))


def linked_pairs(a: Quantised, b: Quantised, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs with cosine >= threshold."""
    exact_in_float = a.q.shape[1] * 127 * 127 < 1 << 24  # sums stay exact integers
    kind = np.float32 if exact_in_float else np.float64
    product = a.q.astype(kind) @ b.q.astype(kind).T
    bound = a.size[:, None] * b.error + a.error[:, None] * (b.size + b.error)
    i, j = np.nonzero(product * (a.scale[:, None] * b.scale) + bound >= threshold - ROUNDING)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), EXACT_PAIRS):
        u, v = i[k : k + EXACT_PAIRS], j[k : k + EXACT_PAIRS]
        keep[k : k + EXACT_PAIRS] = np.einsum("ij,ij->i", a.unit[u], b.unit[v]) >= threshold
    return i[keep], j[keep]


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("embedding").combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(table.num_rows, -1)


PACKED = "label string, tile int, tiles int, ids array<string>, counts array<long>, dim int, data binary"


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    x = _vectors(table)
    return pa.table({
        "label": pa.array([key[0].as_py()]), "tile": pa.array([key[1].as_py()], pa.int32()), "tiles": table.column("tiles").slice(0, 1).cast(pa.int32()),
        "ids": pa.array([table.column("node").to_pylist()]), "counts": pa.array([table.column("n").to_pylist()], pa.list_(pa.int64())),
        "dim": pa.array([x.shape[1]], pa.int32()), "data": pa.array([x.tobytes()], pa.binary())})


CELL = "node string, links long, root string"


def _cell(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("tile").to_pylist()
        parts = [Quantised(np.frombuffer(r["data"], np.float64).reshape(-1, r["dim"])) for r in rows]
        counts = [np.array(r["counts"], np.int64) for r in rows]
        same = len(rows) == 1
        if same and key[1].as_py() != key[2].as_py():  # the other tile is empty
            return pa.table({"node": pa.array([], pa.string()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.string())})
        a, b = 0, len(rows) - 1
        i, j = linked_pairs(parts[a], parts[b], threshold)
        if same:
            on = i < j
            i, j = i[on], j[on]
        n, m = len(counts[a]), len(counts[b])
        shift = 0 if same else n
        ids = np.array(rows[0]["ids"] + ([] if same else rows[1]["ids"]), object)
        links = np.zeros(len(ids), np.int64)
        links += np.bincount(i, counts[b][j], len(ids)).astype(np.int64)
        links += np.bincount(j + shift, counts[a][i], len(ids)).astype(np.int64)
        root = local_roots(len(ids), i, j + shift)
        out = np.flatnonzero(links)
        return pa.table({"node": pa.array(ids[out], pa.string()), "links": pa.array(links[out], pa.int64()), "root": pa.array(ids[root[out]], pa.string())})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("embedding"))
    good = (F.col("label").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("embedding", lambda x: x != 0))
    v = v.withColumn("ok", F.coalesce(good, F.lit(False)))
    # -0.0 and 0.0 are one value
    clean = F.transform("embedding", lambda x: x + F.lit(0.0))
    lab = F.concat_ws("/", F.size("embedding").cast("string"), F.col("label"))
    live = v.where("ok").select("vec_id", lab.alias("label"), clean.alias("embedding"))
    live = live.withColumn("node", hash_id("label", "embedding"))
    classes = live.groupBy("label", "node").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = saved(classes, "vector-classes")

    sizes = classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"))
    dealt = classes.select("label", "node", "embedding", "n").join(sizes, "label")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiles = group_arrow(dealt, ["label", "tile"], _pack, PACKED)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    cells = tiles.withColumn("other", other).select(
        "label", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"), "tile", "ids", "counts", "dim", "data")
    found = saved(group_arrow(cells, ["label", "first", "second"], _cell(threshold), CELL), "vector-links")

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("node", "n", "least").join(linked, "node", "left").join(roots, "node", "left")
    of_class = of_class.withColumn("root", F.coalesce("root", "node"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(least, "root").select(
        "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    mine = v.select("vec_id", F.when(F.col("ok"), hash_id(lab, clean)).alias("node"))
    return mine.join(of_class, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))

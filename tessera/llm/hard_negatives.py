"""Hard-negative mining (operator 11): Strassen products of anchor and candidate
tiles, then mergeable heaps.

The anchors (a stated query set) are compared with every row. They are taken in
passes of about ``PASS_BYTES``, each broadcast, and every task holds one tile of
candidates at a time where the rows lie: candidates are never copied or
shuffled, and the number of passes grows with the anchors, not the size of one.
Scores are integer inner products from Strassen's recursion on int64 tiles, zero
padded to even sides; its additions are exact integer additions (modulo 2**64,
which any score of 64 bits survives), and a leaf is multiplied in double
precision only where every partial sum is proven to stay below 2**53.

Each task keeps one heap of the best rows for each anchor, folds its tiles into
it and hands on what it holds; the heaps of all tasks merge by rank. First the
positive heaps (rows of the anchor's label); their scores give the windows, and
a second scan fills one window heap for each anchor and positive. No pair
outside a heap is ever emitted.

Edge cases: rows with a null label, a null vector, or a null or non-finite
component take no part. Rows equal in id, label and vector are one row (known by
id and a 64-bit hash of label and vector), so a table loaded twice gives the
same result; rows that share only the id are rows of their own, told apart in ties by
that hash. Ties go to the smaller id; a null id comes last and is never an anchor
(2**63 - 1 stands for it). Vectors of different length have no product: they are
no candidates of one another. Components beyond 2**62 after scaling are held
there, scores at the ends of 64 bits. An empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import drop_at_exit, saved, temporary_folder
from tessera.session import ship_library

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: The window: LOW * positive <= 100 * negative <= HIGH * positive.
LOW, HIGH = 30, 90
LEAF = 32
ANCHOR_TILE, CANDIDATE_TILE = 512, 2048
PASS_BYTES = 16 << 20
MOST = (1 << 63) - 1
LEAST = -MOST


# -- products -----------------------------------------------------------------

def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == object or not a.size or not b.size:
        return a @ b
    top = max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min())) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(a: np.ndarray) -> np.ndarray:
    n, m = a.shape
    return a if not (n % 2 or m % 2) else np.pad(a, ((0, n % 2), (0, m % 2)))


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b by seven half-size products a level, until a side is ``leaf`` or less."""
    n, m = a.shape[0], b.shape[1]
    if min(n, a.shape[1], m) <= leaf:
        return _leaf(a, b)
    a, b = _even(a), _even(b)
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * k), p1.dtype)
    out[:i, :k] = p1 + p4 - p5 + p7
    out[:i, k:] = p3 + p5
    out[i:, :k] = p2 + p4
    out[i:, k:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the rows of b as int64; held at the ends of its range."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    top = [max(int(x.max()), -int(x.min())) for x in (a, b)]
    if top[0] * top[1] * a.shape[1] <= MOST:
        return strassen(a, b.T)
    wide = strassen(a.astype(object), b.T.astype(object))
    return np.array([[min(MOST, max(LEAST, int(v))) for v in row] for row in wide], np.int64).reshape(wide.shape)


# -- heaps --------------------------------------------------------------------

class Heaps:
    """The best ``k`` distinct rows of each of n heaps: higher scores first, then smaller ids, then smaller hashes."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), MOST)
        self.tag = np.full((n, k), MOST)
        self.size = np.zeros(n, np.int64)

    def push(self, heaps: np.ndarray, s: np.ndarray, ok: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> None:
        """Offers s[i, j], the score of row j, to heap heaps[i] wherever ok[i, j]. The rows are distinct."""
        last = self.score[heaps, -1][:, None]
        beat = ok & ((s > last) | ((s == last) & (ids <= self.id[heaps, -1][:, None])))
        many = np.flatnonzero(beat.sum(axis=1) > 4 * self.k)
        if len(many):  # only the k best of this tile can enter
            low = np.where(beat[many], s[many], np.iinfo(np.int64).min)
            kth = np.partition(low, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            beat[many] &= s[many] >= kth[:, None]
        i, j = np.nonzero(beat)
        if not len(i):
            return
        touched = np.unique(i)
        h = heaps[touched]
        old = np.arange(self.k) < self.size[h][:, None]
        row = np.concatenate([np.searchsorted(touched, i), np.nonzero(old)[0]])
        score = np.concatenate([s[i, j], self.score[h][old]])
        ident = np.concatenate([ids[j], self.id[h][old]])
        tag = np.concatenate([tags[j], self.tag[h][old]])
        order = np.lexsort((tag, ident, ~score, row))
        row, score, ident, tag = row[order], score[order], ident[order], tag[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (ident[1:] != ident[:-1]) | (tag[1:] != tag[:-1])
        row, score, ident, tag = row[new], score[new], ident[new], tag[new]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        on = place < self.k
        row, place = row[on], place[on]
        for table, values in ((self.score, score), (self.id, ident), (self.tag, tag)):
            table[h[row], place] = values[on]
        self.size[h] = np.bincount(row, minlength=len(h))

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(heap, score, id, hash) of everything held."""
        on = np.arange(self.k) < self.size[:, None]
        return np.nonzero(on)[0], self.score[on], self.id[on], self.tag[on]


# -- the two scans ------------------------------------------------------------

HELD = T.StructType([T.StructField("heap", T.IntegerType()), T.StructField("score", T.LongType()),
                     T.StructField("id", T.LongType()), T.StructField("tag", T.LongType())])


def _matrix(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64).reshape(-1, dim) if dim else np.zeros((len(column), 0))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * flat), -(2.0**62), 2.0**62).astype(np.int64)


def _by_length(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each vector length with the places of its rows."""
    length = np.asarray(pc.list_value_length(table.column("v")))
    for dim in np.unique(length):
        yield int(dim), np.flatnonzero(length == dim)


class Anchors:
    """The anchors of one pass, by vector length and label."""

    def __init__(self, table: pa.Table, scale: float):
        self.n = table.num_rows
        self.id = table.column("id").to_numpy()
        self.tag = table.column("tag").to_numpy()
        label = table.column("label").combine_chunks()
        self.labels = label.unique()
        self.label = np.asarray(pc.index_in(label, value_set=self.labels))
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim, at in _by_length(table):
            at = at[np.argsort(self.label[at], kind="stable")]
            self.groups[dim] = at, _matrix(table.column("v").combine_chunks().take(pa.array(at)), dim, scale)


Tile = Callable[[Heaps, Anchors, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]


def _scan(rows: DataFrame, shared: object, heaps: Callable[[Anchors], Heaps], same_label: bool, scale: float, push: Callable) -> DataFrame:
    """One scan of all rows against the anchors of a pass: what the heaps of each task hold."""
    arrow = to_arrow_schema(HELD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, extra = shared.value
        held = heaps(anchors)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            labels = np.asarray(pc.fill_null(pc.index_in(batch.column("label"), value_set=anchors.labels), -1))
            for dim, at in _by_length(batch):
                if dim not in anchors.groups:
                    continue
                own, matrix = anchors.groups[dim]
                order = np.lexsort((tags[at], ids[at]))  # equal rows are one row
                at = at[order]
                new = np.ones(len(at), bool)
                new[1:] = (ids[at[1:]] != ids[at[:-1]]) | (tags[at[1:]] != tags[at[:-1]])
                at = at[new]
                x = _matrix(batch.column("v").take(pa.array(at)), dim, scale)
                if same_label:  # only the rows and anchors of one label meet
                    codes = labels[at]
                    parts = [(np.flatnonzero(codes == c), np.flatnonzero(anchors.label[own] == c)) for c in np.unique(codes[codes >= 0])]
                else:
                    parts = [(np.arange(len(at)), np.arange(len(own)))]
                for mine, theirs in parts:
                    for a in range(0, len(theirs), ANCHOR_TILE):
                        rows_a = theirs[a : a + ANCHOR_TILE]
                        for b in range(0, len(mine), CANDIDATE_TILE):
                            rows_b = mine[b : b + CANDIDATE_TILE]
                            here = at[rows_b]
                            push(held, anchors, extra, own[rows_a], scores(matrix[rows_a], x[rows_b]), labels[here], ids[here], tags[here])
        heap, score, ident, tag = held.held()
        if len(heap):
            yield pa.RecordBatch.from_arrays([pa.array(heap, pa.int32()), pa.array(score), pa.array(ident), pa.array(tag)], schema=arrow)

    merged = rows.mapInArrow(run, HELD)
    best = Window.partitionBy("heap").orderBy(F.desc("score"), "id", "tag")
    return merged.dropDuplicates(["heap", "id", "tag"]).withColumn("rank", F.row_number().over(best))


def _push_positive(held: Heaps, anchors: Anchors, _: object, own: np.ndarray, s: np.ndarray, labels: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> None:
    other = (anchors.id[own][:, None] != ids) | (anchors.tag[own][:, None] != tags)
    held.push(own, s, other & (anchors.label[own][:, None] == labels), ids, tags)


def _push_window(per: int) -> Callable:
    def push(held: Heaps, anchors: Anchors, extra: tuple, own: np.ndarray, s: np.ndarray, labels: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> None:
        low, high = extra
        differ = anchors.label[own][:, None] != labels
        for j in range(per):
            slot = own * per + j
            if (low[slot] <= high[slot]).any():
                held.push(slot, s, differ & (s >= low[slot][:, None]) & (s <= high[slot][:, None]), ids, tags)

    return push


RESULT = T.StructType([T.StructField("anchor_id", T.LongType()), T.StructField("positive_id", T.LongType()), T.StructField("rank", T.IntegerType()),
                       T.StructField("negative_id", T.LongType()), T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())])


def _known(col: str) -> Column:
    return F.when(F.col(col) != MOST, F.col(col))


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE,
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` holds: one row for each anchor, positive and negative."""
    spark: SparkSession = vectors.sparkSession
    ship_library(spark)
    doubles = F.col(vector_col).cast("array<double>")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), doubles.alias("v"),
                       F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    v = v.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    v = v.select(F.coalesce("id", F.lit(MOST)).alias("id"), "label", "v", F.xxhash64("label", "v").alias("tag"), (F.col("is_anchor") & F.col("id").isNotNull()).alias("is_anchor"))
    rows = v.select("id", "tag", "label", "v")
    taken = saved(v.where("is_anchor").dropDuplicates(["id", "tag"]).select("id", "tag", "label", "v"), "anchors")
    size = taken.agg(F.sum(F.size("v") * F.lit(8) + F.lit(64)).alias("bytes")).first()["bytes"] or 0
    passes = -(-size // pass_bytes)
    out = temporary_folder(spark, "hard-negatives")
    drop_at_exit(spark, out)
    spark.createDataFrame([], RESULT).write.parquet(out)
    for k in range(passes):
        part = taken.where(F.pmod(F.xxhash64("id", "tag", F.lit("pass")), F.lit(passes)) == k)
        table = part.orderBy("id", "tag").toArrow()
        if not table.num_rows:
            continue
        group = Anchors(table, scale)
        shared = spark.sparkContext.broadcast((group, None))
        found = _scan(rows, shared, lambda a: Heaps(a.n, positives), True, scale, _push_positive).where(F.col("rank") <= positives).toArrow()
        bound = _windows(found, group.n, positives, low, high)
        shared.unpersist()
        shared = spark.sparkContext.broadcast((group, bound[:2]))
        worst = _scan(rows, shared, lambda a: Heaps(a.n * positives, negatives), False, scale, _push_window(positives)).where(F.col("rank") <= negatives)
        slots = spark.createDataFrame(pa.table({
            "heap": pa.array(bound[2], pa.int32()), "anchor_id": group.id[bound[2] // positives], "positive_id": bound[3], "positive_score": bound[4]}))
        worst.join(slots, "heap").select(
            "anchor_id", _known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), _known("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        shared.destroy()
    return spark.read.schema(RESULT).parquet(out)


def _windows(found: pa.Table, n: int, per: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """Bounds of the negative scores of every (anchor, positive) slot; slot, id and score of each positive found."""
    first, last = np.full(n * per, MOST), np.full(n * per, LEAST)
    slot = found.column("heap").to_numpy().astype(np.int64) * per + found.column("rank").to_numpy() - 1
    score = found.column("score").to_numpy()
    # low * p <= 100 * s <= high * p, in whole numbers
    first[slot] = [-((-low * int(p)) // 100) for p in score]
    last[slot] = [(high * int(p)) // 100 for p in score]
    return first, last, slot, found.column("id").to_numpy(), score

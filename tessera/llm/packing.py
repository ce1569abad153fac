"""Best-fit packing (operator 3).

Documents become token ids plus an end id; those longer than ``capacity`` are
cut into pieces of ``capacity`` ids, the remainder first. Pieces go longest
first, each into the open sequence with the tightest room that still fits
(best-fit decreasing); a segment tree over remaining capacities finds that
room in logarithmic time.

Piece lengths are integers up to the capacity, so equal lengths are placed in
bulk: the driver sees one count per length (``capacity`` rows at most, however
many documents there are) and returns placement runs; the number of runs
depends on the capacity alone. Each piece then finds its place from its rank
among the pieces of its length. Ranks come from hash buckets inside a length
plus the sizes of the buckets before, so a length shared by a third of all
pieces is still spread over many tasks.

Edge cases: a null or empty text is the end id alone; repeated rows are packed
one by one; an empty table gives no rows; a null id stays null. Only the named
columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.llm import bpe, scan
from tessera.llm.common import map_arrow, saved

CAPACITY = 2048
RANK_BUCKETS = 1024
VOCABULARY = "byte_bpe_50k.json"
END_ID = 0

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


class RoomTree:
    """Segment tree over remaining capacities: the smallest room >= x in use."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.used = np.zeros(2 * self.size, bool)

    def set(self, room: int, on: bool) -> None:
        i = room + self.size
        self.used[i] = on
        while i > 1:
            i >>= 1
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]

    def tightest(self, room: int) -> int | None:
        i = room + self.size
        if self.used[i]:
            return room
        while i > 1:  # up until a right neighbour is in use, then down its left side
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places counts[length] pieces of each length. Rows of the result, sorted by
    length and rank: length, first rank, pieces a sequence, first sequence,
    first offset. Also the number of sequences."""
    tree = RoomTree(capacity)
    rooms: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            stack = rooms.setdefault(room, [])
            if stack and stack[-1][0] + stack[-1][1] == first:
                stack[-1] = (stack[-1][0], stack[-1][1] + n)
            else:
                stack.append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            each = room // length  # the next equal piece finds this sequence the tightest again
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            runs.append((length, rank, each, first, capacity - room))
            leave(room - each * length, first, full)
            if rest:
                leave(room - rest * length, first + full, 1)
            used = full + (1 if rest else 0)
            leave(room, first + used, n - used)
            rank += full * each + rest
            left -= full * each + rest
    return np.array(sorted(runs), np.int64).reshape(-1, 5), sequences


def place(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of given lengths and ranks."""
    shift = np.int64(44)
    key = (runs[:, 0] << shift) + runs[:, 1]
    at = np.searchsorted(key, (length << shift) + rank, "right") - 1
    r = rank - runs[at, 1]
    each = runs[at, 2]
    return runs[at, 3] + r // each, runs[at, 4] + (r % each) * length


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int | None = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        enc = bpe.encoder(vocabulary)
        end = np.array([] if end_id is None else [end_id], "<u4")
        doc_ids = batch.column("doc_id")
        for i, j, buf, offs in scan.text_slices(batch.column("text"), bpe.SLICE_BYTES):
            out: dict[str, list] = {f.name: [] for f in schema.fields}
            ids, at = enc.encode(buf, offs)
            for t, doc_id in enumerate(doc_ids.slice(i, j - i).to_pylist()):
                got = np.concatenate([ids[at[t] : at[t + 1]].astype("<u4"), end])
                first = len(got) % capacity or min(len(got), capacity)
                cuts = [0, *range(first, len(got) + 1, capacity)] if len(got) else []
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for name, v in (("doc_id", doc_id), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(got[a:b].data))):
                        out[name].append(v)
                    if with_ids:
                        out["ids"].append(got[a:b].astype(np.int32))
            yield out

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), fn, schema)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int | None = END_ID,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    cut = saved(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int")
    cut = cut.withColumn("salt", salt)
    sizes = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    ahead = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    counts = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # a row per length
    runs, _ = best_fit(counts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rn", F.row_number().over(order)).join(ahead, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("rn") - 1).drop("salt", "rn", "ahead")
    names = [f.name for f in ranked.schema.fields if f.name != "rank"]
    order_of = [*PIECES.names, *(["ids"] if with_ids else [])]
    schema = T.StructType([*(ranked.schema[n] for n in order_of), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    assert set(names) == set(order_of)

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        seq, off = place(shared.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        yield {**{n: batch.column(n) for n in order_of}, "sequence_id": seq, "offset": off}

    return map_arrow(ranked, fn, schema)

"""Token counts (operator 8) without materialising ids.

The unit is the chunk of ``bpe``: a stretch of text that no pre-token of the
tokenizer crosses at either end.

1. Each task reduces whole texts to distinct chunks with their frequency; after
   one shuffle by chunk hash, every distinct chunk of the corpus is encoded
   once and its number of tokens kept.
2. The counts of the most frequent chunks are broadcast: at most
   ``COMMON_CHUNKS`` of them, a fixed number. Each text is reduced again to its
   chunk frequencies; frequent chunks are summed at once, and only the others
   are joined with the table of step 1 and summed per document.

So the hot keys never enter the join, and no list of ids is ever made.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are
counted one by one; an empty table gives no rows; a null id stays null. Only
the named columns are read. Chunks are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm import bpe, scan
from tessera.llm.common import list_array, map_arrow, saved
from tessera.session import ship_library

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
COMMON_CHUNKS = 1 << 19

FREQUENCIES = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("freq", T.LongType()), T.StructField("data", T.BinaryType())])


def _frequencies(texts: DataFrame, vocabulary: str) -> DataFrame:
    """Distinct chunks of each batch with their frequency."""
    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        enc = bpe.encoder(vocabulary)
        seen = np.zeros(0, np.uint64)
        freq = np.zeros(0, np.int64)
        data: list[tuple[np.ndarray, pa.Array]] = []
        for _, _, buf, offs in scan.text_slices(batch.column("text"), bpe.SLICE_BYTES):
            keys, s, e, which, _ = enc.distinct(buf, offs)
            n = np.bincount(which, minlength=len(keys))
            k = np.searchsorted(seen, keys)
            old = np.zeros(len(keys), bool)
            inside = k < len(seen)
            old[inside] = seen[k[inside]] == keys[inside]
            freq[k[old]] += n[old]
            new = ~old
            raw = buf.tobytes()
            data.append((keys[new], pa.array([raw[a:b] for a, b in zip(s[new].tolist(), e[new].tolist())], pa.binary())))
            seen, freq = np.insert(seen, k[new], keys[new]), np.insert(freq, k[new], n[new])
        for keys, chunks in data:
            yield {"chunk": keys.view(np.int64), "freq": freq[np.searchsorted(seen, keys)], "data": chunks}

    return map_arrow(texts.select("text"), fn, FREQUENCIES)


COUNTS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("freq", T.LongType()), T.StructField("pieces", T.LongType())])


def chunk_counts(texts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every distinct chunk (hash) with its frequency and number of tokens."""
    ship_library(texts.sparkSession)
    names = to_arrow_schema(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(vocabulary)
        open_: tuple[int, int, bytes] | None = None

        def out(chunk: np.ndarray, freq: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
            _, n = enc._encode_new([d.decode("utf-8", "replace") for d in data])
            return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(freq, pa.int64()), pa.array(n, pa.int64())], schema=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, freq = batch.column("chunk").to_numpy(), batch.column("freq").to_numpy()
            starts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            key, total = chunk[starts], np.add.reduceat(freq, starts)
            data = batch.column("data").take(pa.array(starts)).to_pylist()
            if open_ and open_[0] == key[0]:
                total[0] += open_[1]
            elif open_:
                yield out(np.array([open_[0]]), np.array([open_[1]]), [open_[2]])
            open_ = (int(key[-1]), int(total[-1]), data[-1])
            if len(key) > 1:
                yield out(key[:-1], total[:-1], data[:-1])
        if open_:
            yield out(np.array([open_[0]]), np.array([open_[1]]), [open_[2]])

    return _frequencies(texts, vocabulary).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, COUNTS)


def _common(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of the chunks whose frequency reaches a power of two, ``most`` of them at most; that power."""
    level = F.floor(F.log2("freq")).cast("int")
    sizes = {r[0]: r[1] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1))).collect()}
    cut = max(sizes, default=0) + 1
    while cut - 1 >= 0 and sum(n for k, n in sizes.items() if k >= cut - 1) <= most:
        cut -= 1
    least = 1 << cut
    got = counts.where(F.col("freq") >= least).select("chunk", "pieces").toArrow()
    keys, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order], least


RARE = T.ArrayType(T.StructType([T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType())]))
DOCS = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                     T.StructField("known", T.LongType()), T.StructField("rare", RARE)])


def _per_document(docs: DataFrame, shared: object, vocabulary: str) -> DataFrame:
    """Each row with a number of its own, the tokens of its frequent chunks and the frequencies of its rare ones."""
    names = to_arrow_schema(DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(vocabulary)
        common, pieces = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i, j, buf, offs in scan.text_slices(batch.column("text"), bpe.SLICE_BYTES):
                keys, _, _, which, at = enc.distinct(buf, offs)
                k = np.minimum(np.searchsorted(common, keys), max(len(common) - 1, 0))
                is_known = common[k] == keys if len(common) else np.zeros(len(keys), bool)
                n = np.where(is_known, pieces[k], 0) if len(common) else np.zeros(len(keys), np.int64)
                sums = np.concatenate([[0], np.cumsum(n[which])])
                text = np.repeat(np.arange(j - i), np.diff(at))
                rare = ~is_known[which]
                pair, times = np.unique(text[rare] * np.int64(max(len(keys), 1)) + which[rare], return_counts=True)
                owner, key = pair // max(len(keys), 1), keys[pair % max(len(keys), 1)] if len(keys) else np.zeros(0, np.uint64)
                items = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(times, pa.int64())], fields=list(names.field("rare").type.value_type))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + j - i), pa.int64()), batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offs), pa.int64()),
                    pa.array(np.diff(sums[at]), pa.int64()), list_array(items, np.bincount(owner, minlength=j - i)).cast(names.field("rare").type)], schema=names)
                row += j - i

    return docs.mapInArrow(run, DOCS)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, common: int = COMMON_CHUNKS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit per document."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = saved(chunk_counts(d, vocabulary), "chunk-counts")
    keys, pieces, least = _common(counts, common)
    shared = d.sparkSession.sparkContext.broadcast((keys, pieces))
    rows = saved(_per_document(d, shared, vocabulary), "chunk-frequencies")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.chunk", "r.n")
    rare = rare.join(counts.where(F.col("freq") < least).select("chunk", "pieces"), "chunk")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    out = rows.select("row", "doc_id", "n_bytes", "known").join(rare, "row", "left")
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return out.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))

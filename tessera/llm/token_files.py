"""Token-ID files (operator 7): canonical length-limited Huffman coding.

``write_tokens`` writes a folder with two parts:

* ``codebook``: one row, the code length of every id (from global counts) and
  the longest code; the canonical code follows from it.
* ``blocks``: one row per block of whole documents in ascending id order:
  file and block number, ids before the block in its file, ids in the block,
  document ids and their id counts, the bit offset of every ``CHECKPOINT``-th
  id, and the bit stream. A block decodes on its own, and inside it every
  checkpoint starts a lane of its own.

The rows sit in Parquet, because that is what executors can write to and read
from any shared store; the bit streams are stored uncompressed.

``read_tokens`` decodes the blocks with a table lookup per id, all lanes of
some blocks at once.

Edge cases: a null or empty text is the end id alone; null ids come first;
equal ids follow each other by content; repeated rows are written one by one;
an empty table writes a codebook without ids and no blocks. Only the named
columns are read. Blocks hold whole documents, so a very long one makes a
large block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.llm import bpe, huffman, scan
from tessera.llm.common import drop_at_exit, map_arrow, saved, temporary_folder
from tessera.session import ship_library

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 1 << 16
CHECKPOINT = 256
DECODE_IDS = 1 << 20

TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
BLOCKS = T.StructType([
    T.StructField("file", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("before", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_sizes", T.ArrayType(T.LongType())), T.StructField("checkpoints", T.ArrayType(T.LongType())),
    T.StructField("bits", T.LongType()), T.StructField("stream", T.BinaryType())])


def tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the packed ids (little-endian, 2 bytes if the vocabulary allows, else 4) with the end id."""

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        enc = bpe.encoder(vocabulary)
        end = b"" if end_id is None else np.array([end_id], enc.kind).tobytes()
        for i, j, buf, offs in scan.text_slices(batch.column("text"), bpe.SLICE_BYTES):
            ids, at = enc.encode(buf, offs)
            packed = [ids[a:b].tobytes() + end for a, b in zip(at, at[1:])]
            yield {"doc_id": batch.column("doc_id").slice(i, j - i), "ids": pa.array(packed, pa.binary())}

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), fn, TOKENS)


def id_width(vocabulary: str) -> tuple[np.dtype, int]:
    enc = bpe.encoder(vocabulary)
    return enc.kind, enc.size


def count_ids(toks: DataFrame, kind: np.dtype, size: int) -> np.ndarray:
    """How often each id occurs; one partial row per batch and id in use."""
    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        n = np.zeros(size, np.int64)
        for packed in batch.column("ids"):
            n += np.bincount(np.frombuffer(packed.as_buffer(), kind), minlength=size) if packed.as_buffer().size > 4 * size else 0
        small = b"".join(p.as_py() for p in batch.column("ids") if p.as_buffer().size <= 4 * size)
        n += np.bincount(np.frombuffer(small, kind), minlength=size)
        used = np.flatnonzero(n)
        yield {"id": used, "n": n[used]}

    part = map_arrow(toks.select("ids"), fn, T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())]))
    counts = np.zeros(size, np.int64)
    for r in part.groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row per id of the vocabulary at most
        counts[r["id"]] = r["n"]
    return counts


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int | None = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", max_bits: int = huffman.MAX_BITS) -> None:
    """Encodes all texts and writes the files under ``path``."""
    spark = docs.sparkSession
    ship_library(spark)
    kind, size = id_width(vocabulary)
    toks = saved(tokens(docs, vocabulary, end_id, id_col, text_col), "tokens")
    lengths = huffman.code_lengths(count_ids(toks, kind, size), max_bits)
    book = spark.createDataFrame([(size, max_bits, bytearray(lengths.tobytes()))], "vocabulary_size int, max_bits int, lengths binary")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(lengths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared.value
        codes = huffman.canonical_codes(lengths)
        file, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            stream, start, bits = huffman.encode(ids, lengths, codes)
            row = {"file": file, "block": block, "before": before, "n_ids": len(ids), "doc_ids": [d for d, _ in held],
                   "doc_sizes": [len(x) for _, x in held], "checkpoints": start[::CHECKPOINT].tolist(), "bits": bits, "stream": stream}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                held.append((doc_id, np.frombuffer(packed.as_py(), kind)))
                n += len(held[-1][1])
                if n >= BLOCK_IDS:
                    yield flush()
                    block, before, n = block + 1, before + n, 0
                    held.clear()
        if held:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(BLOCKS)
    keyed = toks.withColumn("tie", F.xxhash64("ids"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                       T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def decode_rows(rows: list[dict], table: tuple[np.ndarray, np.ndarray, int]) -> Iterator[tuple[dict, np.ndarray]]:
    """Ids of each block row; lanes of blocks up to DECODE_IDS ids step together."""
    group: list[dict] = []
    n = 0
    for r in [*rows, None]:
        if r is not None:
            group.append(r)
            n += r["n_ids"]
        if group and (r is None or n >= DECODE_IDS):
            data = np.frombuffer(b"".join(g["stream"] for g in group), np.uint8)
            at = np.cumsum([0, *(len(g["stream"]) for g in group)])
            starts = np.concatenate([np.array(g["checkpoints"], np.int64) + 8 * a for g, a in zip(group, at)])
            counts = np.concatenate([np.minimum(CHECKPOINT, g["n_ids"] - CHECKPOINT * np.arange(len(g["checkpoints"]))) for g in group]).astype(np.int64)
            ids = huffman.decode(data, starts, counts, table)
            a = 0
            for g in group:
                yield g, ids[a : a + g["n_ids"]]
                a += g["n_ids"]
            group, n = [], 0


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, if asked, ids; from the files alone."""
    book = spark.read.parquet(f"{path}/codebook").first()
    lengths = np.frombuffer(bytes(book["lengths"]), np.uint8)
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("ids"))  # a row per file
    run = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("ids").over(run), F.lit(0)).alias("file_start"))
    schema = T.StructType([*RESULT.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    tables: dict[int, tuple] = {}

    def fn(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        if not tables:
            tables[0] = huffman.decode_table(shared.value)
        out: dict[str, list] = {n: [] for n in schema.names}
        for g, ids in decode_rows(batch.to_pylist(), tables[0]):
            a, start = 0, g["file_start"] + g["before"]
            for doc_id, size in zip(g["doc_ids"], g["doc_sizes"]):
                own = ids[a : a + size]
                for name, v in (("doc_id", doc_id), ("start", start + a), ("n_tokens", size), ("ids_crc32", zlib.crc32(own.data))):
                    out[name].append(v)
                if with_ids:
                    out["ids"].append(own.astype(np.int32))
                a += size
        yield out

    joined = blocks.join(files, "file").select("file_start", "before", "n_ids", "doc_ids", "doc_sizes", "checkpoints", "stream")
    return map_arrow(joined, fn, schema)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int | None = END_ID) -> DataFrame:
    """Writes the files to a new shared folder and reads them back."""
    path = temporary_folder(docs.sparkSession, "token-files")
    write_tokens(docs, path, vocabulary, end_id)
    drop_at_exit(docs.sparkSession, path)
    return read_tokens(docs.sparkSession, path)

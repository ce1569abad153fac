"""Helpers shared by the corpus operators: inputs, written tables, row keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpoint_subdir, ship_library
from tessera.sources.tables import load


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to a new folder of the shared checkpoint folder and reads
    it back, so later jobs neither recompute it nor depend on one executor. The
    folder goes when the application ends."""
    spark = df.sparkSession
    path = temporary_folder(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return checkpoint_subdir(spark, f"tessera-{name}-{uuid.uuid4().hex[:12]}")


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has a written folder deleted when the application ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores added until no column has that name."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def text_of(df: DataFrame, col: str) -> Column:
    """The text column as a string; null is empty."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def hash_id(*cols: Column | str) -> Column:
    """128-bit key of the given values, as 32 hex digits (nulls count as a value)."""
    parts = [F.lit(0) if c is None else (F.col(c) if isinstance(c, str) else c) for c in cols]
    flags = [p.isNull() for p in parts]
    return F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts, *flags)), 16, "0") for seed in (1, 2)))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, pa.Array]]], schema: T.StructType) -> DataFrame:
    """mapInArrow with a function from one batch to dictionaries of columns."""
    ship_library(df.sparkSession)
    names = schema.names
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays([_typed(cols[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)


def group_arrow(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], pa.Table], schema: str) -> DataFrame:
    """applyInArrow over the groups of ``keys``; every group must be bounded."""
    ship_library(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(fn, schema)


def _typed(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def list_array(values: pa.Array, sizes: object) -> pa.ListArray:
    """A list column from flat values and the size of each list."""
    import numpy as np

    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal (non-null) integer keys as one table each;
    holds one group and one batch. The input must be sorted by the keys."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is None or tuple(c[0] for c in cols) != last
        starts = np.flatnonzero(new)
        if held and len(starts):
            head = batch.slice(0, starts[0])
            yield pa.Table.from_batches([*held, head] if len(head) else held)
            held = []
        bounds = np.append(starts, n)
        for a, b in zip(bounds[:-2], bounds[1:-1]):
            yield pa.Table.from_batches([batch.slice(a, b - a)])
        a = bounds[-2] if len(starts) else 0
        held.append(batch.slice(a, n - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)

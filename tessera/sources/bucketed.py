"""Tables laid out by a key, so that joins on it need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tessera.sources.stage import new_folder


def buckets_for(*frames: DataFrame, bucket_bytes: int = 128 << 20, least: int = 8) -> int:
    """Buckets that hold about ``bucket_bytes`` of the largest frame, by Spark's estimate of its size; a power of two."""
    size = max(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for df in frames)
    n = least
    while n * bucket_bytes < size:
        n *= 2
    return n


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df`` written as a table of ``buckets`` buckets sorted by ``key`` and read
    back. Two such tables with the same number of buckets join on their keys, and
    each groups by its key, without an exchange. The files lie in the session's shared
    folder and go when the application ends."""
    spark = df.sparkSession
    table = f"tessera_{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", new_folder(spark, name)).saveAsTable(table))
    return spark.table(table)

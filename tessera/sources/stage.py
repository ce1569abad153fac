"""Tables written to the session's shared folder: they cut lineage, survive lost
executors, and go when the application ends."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tessera.session import checkpoint_subdir


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, deleted when the application ends."""
    path = checkpoint_subdir(spark, f"tessera-{name}-{uuid.uuid4().hex[:12]}")
    place, fs = hadoop_path(spark, path)
    fs.deleteOnExit(place)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """(path, file system) of Hadoop's API, for whatever store the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """While it holds, a query's shuffle files are deleted when it ends, not when the driver happens to
    collect its garbage. For steps that write their result: nothing reads their shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def garbage_freed(spark: SparkSession, seconds: float = 20) -> Iterator[None]:
    """While it holds, the driver collects its garbage every so often: the shuffle files of a loop
    over RDDs are deleted only after the driver's objects for them are."""
    over = threading.Event()

    def collect():
        while not over.wait(seconds):
            spark.sparkContext._jvm.System.gc()

    thread = threading.Thread(target=collect, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()

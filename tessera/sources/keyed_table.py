"""A keyed table that streams edit and insert into (A-9, A-10).

Layout under one path: ``base=<n>`` is a whole table, holding all batches up to
n; ``delta=<n>`` holds the latest change per key of batch n. A batch
writes nothing but its own delta, in overwrite mode, so its cost follows the batch
and not the table, and a batch that is replayed after a crash writes the same rows to
the same place. A folder counts once Spark has committed it (``_SUCCESS``); half a
batch is never read. ``compact`` folds the deltas into a new base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_subdir
from tessera.sources.stage import hadoop_path


class KeyedTable:
    """Rows by ``key``; of several changes of a key the one with the largest
    ``order`` holds (of equal ones the later batch, then the larger row), and any
    change beats a row of the first base whose order is null."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], order: str):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), list(key), order

    def _committed(self, kind: str) -> list[int]:
        place, fs = hadoop_path(self.spark, f"{self.path}/{kind}=*/_SUCCESS")
        found = fs.globStatus(place) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row per key; rows have the column ``_batch``. A hash aggregate, no sort per key."""
        rest = [c for c in rows.columns if c not in self.key and c != "_batch"]
        whole = F.struct(*rest)
        place = F.struct(F.col(self.order).alias("o"), F.col("_batch").alias("b"), F.to_json(whole).alias("r"))
        best = rows.groupBy(*self.key).agg(F.max_by(whole, place).alias("_r"), F.max_by("_batch", place).alias("_batch"))
        return best.select(*self.key, *[F.col("_r")[c].alias(c) for c in rest], "_batch")

    def create(self, base: DataFrame) -> None:
        """The first base (batch -1): at most one row per key."""
        if self.order not in base.columns:
            raise ValueError(f"the base needs the order column {self.order!r} (null where nothing is known)")
        base.withColumn("_batch", F.lit(-1).cast("long")).write.parquet(f"{self.path}/base=-1")

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Edits and inserts of one batch; the function for ``foreachBatch``."""
        rows = changes.withColumn("_batch", F.lit(batch_id).cast("long"))
        self._latest(rows).write.mode("overwrite").parquet(f"{self.path}/delta={batch_id}")

    def _rows(self) -> tuple[DataFrame, int]:
        base = self._committed("base")[-1]
        deltas = [n for n in self._committed("delta") if n > base]
        first = self.spark.read.parquet(f"{self.path}/base={base}")
        if not deltas:
            return first, base
        new = self.spark.read.schema(first.schema).parquet(*[f"{self.path}/delta={n}" for n in deltas])
        return self._latest(first.unionByName(new)), deltas[-1]

    def read(self) -> DataFrame:
        """The table as of the last committed batch."""
        return self._rows()[0].drop("_batch")

    def compact(self) -> int:
        """Folds all committed deltas into a new base; returns its batch."""
        rows, last = self._rows()
        if last not in self._committed("base"):
            rows.write.mode("overwrite").parquet(f"{self.path}/base={last}")
        return last

    def vacuum(self) -> None:
        """Deletes what the newest base has replaced. No reader of an older state may be open."""
        base = self._committed("base")[-1]
        for kind, stale in (("base", lambda n: n < base), ("delta", lambda n: n <= base)):
            for n in filter(stale, self._committed(kind)):
                place, fs = hadoop_path(self.spark, f"{self.path}/{kind}={n}")
                fs.delete(place, True)

    def upsert_stream(self, changes: DataFrame, name: str):
        """Starts the stream of changes into the table, with its checkpoint ``name``
        in the shared folder; a restart goes on where it stopped."""
        return (changes.writeStream.foreachBatch(self.apply).outputMode("append")
                .option("checkpointLocation", checkpoint_subdir(self.spark, name)).trigger(availableNow=True).start())

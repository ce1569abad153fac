"""Sharding by proportional stratified interleaving (operator 4).

Rows are shuffled by a seeded hash of their id inside each source, ranked, and
placed on a line at (rank - u) / rows of the source, where u in (0, 1) is
fixed per source. Sorted by that fractional rank, every stretch of the line
holds each source in proportion, so cutting it into equal counts gives shards
that all match the mixture.

Law: ``rows``; the counts of two shards differ by one at most. Equal texts are
ordinary rows here: they may land in different shards.

No source and no stretch of the line is sorted in one task. Ranks come from
hash buckets inside the source plus the sizes of the buckets before; positions
come from ``LINE_CELLS`` equal cells of the line plus the sizes of the cells
before. Only the cell sizes are broadcast: one row per cell at most.

Edge cases: a null text has size 1 and the checksum of the empty text; a null
source is a source of its own; a null id is an id of its own; repeated rows
are placed one by one (equal rows are interchangeable); an empty table gives
no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import saved, text_of

SOURCE_BUCKETS = 4096
LINE_CELLS = 8192
SEED = 20240607


def _unit(key: Column) -> Column:
    """A 64-bit hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(key, 12).cast("double") + 0.5) / float(1 << 52)


def _source(df: DataFrame, col: str) -> Column:
    s = df[col].cast("string")
    return F.when(s.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), s))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    key = F.xxhash64(F.lit(seed), docs[id_col], docs[id_col].isNull())
    rows = docs.select(
        docs[id_col].alias("id"), _source(docs, source_col).alias("src"), key.alias("key"),
        (F.octet_length(text_of(docs, text_col)).cast("long") + 1).alias("size"),
        F.crc32(text_of(docs, text_col)).alias("crc"), F.xxhash64(text_of(docs, text_col)).alias("tie"))
    bucket = F.floor(_unit(F.col("key")) * SOURCE_BUCKETS).cast("int")
    rows = rows.withColumn("bucket", bucket)

    sizes = docs.select(_source(docs, source_col).alias("src"), key.alias("key")).withColumn("bucket", bucket)
    sizes = sizes.groupBy("src", "bucket").agg(F.count(F.lit(1)).alias("n"))
    in_source = W.partitionBy("src")
    before = in_source.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("src", "bucket", F.sum("n").over(in_source).alias("in_source"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))

    order = W.partitionBy("src", "bucket").orderBy("key", "id", "tie")
    ranked = rows.withColumn("rn", F.row_number().over(order)).join(sizes, ["src", "bucket"])
    start = _unit(F.xxhash64(F.lit(seed), F.lit("source"), F.col("src")))
    place = (F.col("ahead") + F.col("rn") - start) / F.col("in_source")
    line = ranked.select("id", "size", "crc", "tie", "src", place.alias("place")).withColumn(
        "cell", F.least(F.floor(F.col("place") * LINE_CELLS), F.lit(LINE_CELLS - 1)).cast("int"))

    # written once: both the cells' counts and the rows' positions come from it
    line = saved(line, "line")
    cells = line.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    run = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("cell_ahead"),
                         F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    in_cell = W.partitionBy("cell").orderBy("place", F.xxhash64(F.lit(seed), F.col("src")), "src", "id", "tie")
    at = line.withColumn("in_cell", F.row_number().over(in_cell)).join(F.broadcast(cells), "cell")
    pos = F.col("cell_ahead") + F.col("in_cell") - 1
    out = at.withColumn("pos", pos).withColumn("shard", F.expr(f"(pos * {shards}) div total").cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
                      "shard", (F.col("pos") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

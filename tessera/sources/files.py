"""Readers and writers (A-1 .. A-10).

Readers always take an explicit schema where the format allows it (no
``inferSchema`` scan over the data). Writers never collect: they write from
the executors.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import csv_safe, nan_to_null
from tessera.sources.stage import staged

NUMERIC = {"double", "float", "int", "integer", "long", "bigint", "short", "smallint"}


def cast_measures(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Cast measure columns; a failed cast is null (ANSI mode would fail the
    job), NaN becomes null for floating types (A-1 cast step)."""
    out = []
    for c in df.columns:
        if c in casts:
            typ = casts[c]
            x = F.col(c).try_cast(typ)
            if typ in ("double", "float"):
                x = nan_to_null(x)
            out.append(x.alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", casts: dict[str, str] | None = None, **options) -> DataFrame:
    """Load a table with a declared schema, then cast measure columns (A-1)."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    return cast_measures(df, casts) if casts else df


# The post document schema.
POST_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("read", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("linkText", T.StringType()),
    T.StructField("groups", T.StringType()),   # array or scalar in the wild: kept raw, normalised later
    T.StructField("content", T.ArrayType(T.StringType())),
    T.StructField("gallery", T.ArrayType(T.StringType())),
])


def holds_array(spark: SparkSession, path: str) -> bool:
    """Whether the first text of JSON files opens an array: one value over
    several lines rather than one value a line (reads up to the first line that isn't blank)."""
    first = spark.read.text(path).filter(F.trim("value") != "").head()
    return first is not None and first[0].lstrip().startswith("[")


def read_posts(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    """Read posts (A-3) from a JSON array or from JSON lines, as
    :func:`export_posts` writes them.

    ``groups`` may be an array or a single string; it is read as raw JSON text
    and normalised to ``array<string>``; a post without it is in ``recent``. The position
    becomes ``pos``: its place in the array (a file that holds an array is read by one
    task), or its line over all files in the order of their names (read in blocks by many
    tasks). When there are no posts the ``fallback`` frame is returned (one
    ``isEmpty`` check, a single-row probe).
    """
    if holds_array(spark, path):
        df = spark.read.schema(POST_SCHEMA).option("multiLine", True).json(path) \
            .withColumn("pos", F.monotonically_increasing_id())
    else:
        df = numbered_lines(spark.read.schema(POST_SCHEMA).json(path), [], "pos", "posts")
    raw = F.col("groups")
    as_array = F.from_json(raw, "array<string>")
    groups = F.when(raw.isNull(), F.array(F.lit("recent"))) \
        .when(F.trim(raw).startswith("["), as_array) \
        .otherwise(F.array(raw))
    df = df.withColumn("groups", groups)
    if fallback is not None and df.isEmpty():
        return fallback
    return df


def export_posts(df: DataFrame, path: str, pos: str = "pos") -> None:
    """Write posts as JSON lines in their current order (A-4): one ordered
    output file set, ``orderBy`` gives a global order across part files."""
    df.orderBy(pos).write.mode("overwrite").json(path)


def read_chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chat export text files -> ``(chat, line_no, line)`` (A-5); the chat is
    the file path, lines count from 0 in file order.

    A large export is read in blocks by many tasks (:func:`numbered_lines`). Lines
    end with a newline, with or without a carriage return."""
    # one custom separator keeps files splittable and lone carriage returns inside lines
    df = spark.read.option("lineSep", "\n").text(path)
    df = df.select(F.col("_metadata.file_path").alias("chat"), F.regexp_replace("value", "\r$", "").alias("line"), "_metadata")
    return numbered_lines(df, ["chat"], "line_no", "chat-lines").select("chat", "line_no", "line")


def numbered_lines(df: DataFrame, by: Sequence[str], name: str, folder: str) -> DataFrame:
    """Rows of a line-based file scan, numbered from 0 in file order within ``by``
    (within all files in the order of their paths if it is empty).

    Rows are written once with their block and their place in the task that read
    it; a row's number is its place in its block plus the rows of all blocks before it: a
    running sum over one row per block."""
    df = staged(df.select(*[c for c in df.columns if c != "_metadata"], F.col("_metadata.file_path").alias("_file"),
                          F.col("_metadata.file_block_start").alias("_block"),
                          F.monotonically_increasing_id().alias("_at")), folder)
    blocks = df.groupBy(*by, "_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    df = df.join(blocks.select("_file", "_block", "_offset"), ["_file", "_block"])
    return df.withColumn(name, F.col("_at") + F.col("_offset")).drop("_file", "_block", "_at", "_offset")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Sitemap XML -> ``(loc, priority)`` rows (A-6), built-in XML source."""
    schema = "loc string, lastmod string, changefreq string, priority double"
    return (spark.read.format("xml").option("rowTag", "url").schema(schema).load(path)
            .select("loc", "priority"))


def write_sitemap(df: DataFrame, path: str) -> None:
    df.select("loc", "priority").write.mode("overwrite").format("xml") \
        .option("rootTag", "urlset").option("rowTag", "url").save(path)


# File extension -> reader format of read_any.
EXTENSION_FORMATS = {
    ".csv": "csv",
    ".tsv": "csv",
    ".json": "json",
    ".jsonl": "json",
    ".xml": "xml",
    ".parquet": "parquet",
    ".txt": "text",
}


def read_any(spark: SparkSession, path: str, schema=None, row_tag: str = "row") -> DataFrame:
    """Format recognition by extension (A-7): CSV, TSV, JSON, XML, parquet,
    text. A ``.json`` path that opens an array is read as arrays, which may span lines,
    any other as lines. XLSX and DOCX are not read (export them upstream)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    fmt = EXTENSION_FORMATS.get(ext)
    if fmt is None:
        raise ValueError(f"unsupported file type {ext!r}")
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if ext in (".csv", ".tsv"):
        r = r.option("header", True).option("sep", "\t" if ext == ".tsv" else ",")
        if schema is None:
            r = r.option("inferSchema", True)
    if ext == ".json":
        r = r.option("multiLine", holds_array(spark, path))
    if fmt == "xml":
        r = r.option("rowTag", row_tag)
    return r.load(path)


def csv_ready(df: DataFrame, safe: bool = True) -> DataFrame:
    """String columns formula-neutralised (A-8), other columns unchanged."""
    if not safe:
        return df
    return df.select(*[csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c)
                       for c, t in df.dtypes])


def export_csv(df: DataFrame, path: str, safe: bool = True) -> None:
    csv_ready(df, safe).write.mode("overwrite").option("header", True).csv(path)


def stream_source(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Inbound event feed as a file stream with a declared schema (A-9)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def stream_to_files(df: DataFrame, path: str, name: str, output_mode: str = "append",
                    partition_by: Sequence[str] = (), available_now: bool = True,
                    processing_time: str | None = None):
    """Stream sink (A-9): parquet files written exactly once per micro-batch
    (the file sink commits through its metadata log), with the query's
    checkpoint under the session's shared checkpoint folder, so a restarted
    query resumes where it stopped. Returns the running ``StreamingQuery``."""
    from tessera.session import checkpoint_subdir
    w = (df.writeStream.format("parquet").outputMode(output_mode).option("path", path)
         .option("checkpointLocation", checkpoint_subdir(df.sparkSession, name)))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Edit-or-insert (A-10): the latest change per key (``max_by`` on
    ``order``) replaces the base row, new keys are appended. A hash aggregate
    plus an anti join; no window sort per key."""
    key = list(key)
    rest = [c for c in changes.columns if c not in key]
    latest = (changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
              .select(*key, *[F.col("_r")[c].alias(c) for c in rest]))
    kept = base.join(latest.select(*key), key, "left_anti")
    return kept.unionByName(latest.select(*base.columns))

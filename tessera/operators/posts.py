"""Post documents: normalisation, validation, tab/topic filter, metadata
line, read minutes, hashtags and ordering (B-10 .. B-15, F-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import parse_read_minutes, strip_ws

# Defaults of a post.
DEFAULT_GROUPS = ("recent",)
DEFAULT_LINK_TEXT = "Read note"
META_SEPARATOR = " | "
ADMIN_SEPARATOR = " \u00b7 "
HASHTAG_PATTERN = r"hashtag#(\w+)"

STRING_FIELDS = ("title", "topic", "category", "read", "status", "summary", "image", "url", "linkText")


def _split_clean(col, pattern):
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), pattern), lambda s: strip_ws(s)),
                    lambda s: s != "")


def normalize_posts(df: DataFrame, content_raw: str = "content_raw", gallery_raw: str = "gallery_raw") -> DataFrame:
    """Form data -> post (B-10): string fields trimmed; content split on
    blank lines, gallery on newlines, both trimmed with empties dropped;
    empty groups -> ['recent']; empty link text -> 'Read note'."""
    out = df
    for f in STRING_FIELDS:
        if f in df.columns:
            out = out.withColumn(f, strip_ws(F.coalesce(F.col(f), F.lit(""))))
    out = (out.withColumn("content", _split_clean(F.col(content_raw), r"\n\s*\n"))
           .withColumn("gallery", _split_clean(F.col(gallery_raw), r"\n+"))
           .drop(content_raw, gallery_raw))
    groups = F.filter(F.coalesce(F.col("groups"), F.array().cast("array<string>")), lambda g: (g.isNotNull()) & (g != ""))
    out = out.withColumn("groups", F.when(F.size(groups) == 0, F.array(*[F.lit(g) for g in DEFAULT_GROUPS]))
                         .otherwise(groups))
    if "linkText" in out.columns:
        out = out.withColumn("linkText", F.when(F.col("linkText") == "", F.lit(DEFAULT_LINK_TEXT))
                             .otherwise(F.col("linkText")))
    return out


def validate_posts(df: DataFrame) -> DataFrame:
    """Keep posts with a non-empty title and summary (B-11)."""
    return df.filter((F.coalesce(F.col("title"), F.lit("")) != "") & (F.coalesce(F.col("summary"), F.lit("")) != ""))


def filter_posts(df: DataFrame, tab: str, topic: str = "all") -> DataFrame:
    """Visible iff ``tab`` is one of the group words (groups joined by a
    space and split on whitespace) and the topic matches or is 'all' (B-12)."""
    words = F.split(F.concat_ws(" ", F.col("groups")), r"\s+")
    cond = F.array_contains(words, F.lit(tab))
    if topic != "all":
        cond = cond & (F.col("topic") == F.lit(topic))
    return df.filter(cond)


def post_meta(df: DataFrame, name: str = "meta") -> DataFrame:
    """``category: x | read: y | status: z`` with absent parts skipped (B-13)."""
    def part(label, col):
        c = F.col(col)
        return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))
    return df.withColumn(name, F.concat_ws(META_SEPARATOR, part("category", "category"), part("read", "read"),
                                           part("status", "status")))


def admin_meta(df: DataFrame, name: str = "meta") -> DataFrame:
    """Admin line of a post (B-13): topic, category, read and status with their
    own names as defaults, and whether there is an image."""
    def part(col):
        return F.when(F.coalesce(F.col(col), F.lit("")) != "", F.col(col)).otherwise(F.lit(col))
    image = F.when(F.coalesce(F.col("image"), F.lit("")) != "", "image").otherwise("no-image")
    return df.withColumn(name, F.concat_ws(ADMIN_SEPARATOR, part("topic"), part("category"), part("read"), part("status"), image))


def read_minutes(df: DataFrame, col: str = "read", name: str = "read_minutes") -> DataFrame:
    """``'6m'`` -> 6 (B-14)."""
    return df.withColumn(name, parse_read_minutes(F.col(col)))


def extract_hashtags(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per ``hashtag#Name`` token (B-15)."""
    return df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(HASHTAG_PATTERN), 1)).alias("hashtag"))


def prepend(df: DataFrame, new: DataFrame, pos: str = "pos") -> DataFrame:
    """New posts go first, keeping their own relative order (F-5).

    ``new_pos = min(existing) - 1 - (max(new) - pos)``: an order-preserving
    shift computed from two scalar subqueries, so no global window is needed
    however many rows arrive.
    """
    first = df.select(F.min(pos)).scalar()
    last_new = new.select(F.max(pos)).scalar()
    shifted = new.withColumn(pos, (F.coalesce(first, F.lit(0)) - 1 - (last_new - F.col(pos))).cast("long"))
    return shifted.unionByName(df)

"""Post queries over documents turned into post form data.

Binding (chosen here): one post per document; title = first line, summary
= second line, content = the whole text, topic = lang, category = source,
read = minutes at 200 words per minute, status from the quality label
('published' 1 / 'draft' 0 / absent when unlabelled), groups = source plus
'featured' for quality posts, link text empty for toxic posts (so the
default applies), position = doc_id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import WS_CLASS, strip_ws
from tessera.operators import posts as P
from tessera.plans import bindings as B
from tessera.plans.common import tables
from tessera.plans.registry import register
from tessera.sources import files
from tessera.sources.stage import new_folder

W = B.with_ctes


def form_data(spark, sf_dir):
    t = tables(spark, sf_dir)
    words = F.size(F.split(strip_ws(F.col("text")), WS_CLASS + "+"))
    # what is taken from the text is taken before the join, so a query without the content never shuffles it
    d = t.documents.select(
        F.col("doc_id").alias("pos"), "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.try_element_at(F.split("text", "\n"), F.lit(2)).alias("summary"),
        F.col("lang").alias("topic"), F.col("source").alias("category"),
        F.concat(F.ceil(words / 200).cast("string"), F.lit("m")).alias("read"),
        F.col("text").alias("content_raw")).join(t.labels, "doc_id", "left")
    return d.select(
        "pos", "doc_id", "title", "summary", "topic", "category", "read",
        F.when(F.col("quality") == 1, "published").when(F.col("quality") == 0, "draft").alias("status"),
        F.lit("").alias("image"), F.concat(F.lit("/notes/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("toxic") == 1, "").otherwise("Open").alias("linkText"),
        F.filter(F.array(F.col("category"), F.when(F.col("quality") == 1, F.lit("featured"))),
                 lambda g: g.isNotNull()).alias("groups"),
        "content_raw", F.lit("").alias("gallery_raw"))


def posts(spark, sf_dir):
    return P.normalize_posts(form_data(spark, sf_dir))


WSQ = "[ \\t\\n\\r\\f\\x0B]"
STRIP = "regexp_replace(regexp_replace({x}, '^" + WSQ + "+', ''), '" + WSQ + "+\\z', '')"
FORM_CTE = f"""form AS (SELECT d.doc_id AS pos, d.doc_id, split_part(d.text, chr(10), 1) AS title,
    string_split(d.text, chr(10))[2] AS summary, d.lang AS topic, d.source AS category,
    CAST(CAST(ceil(len(string_split_regex({STRIP.format(x='d.text')}, '{WSQ}+')) / 200) AS BIGINT) AS VARCHAR) || 'm' AS read,
    CASE WHEN l.quality = 1 THEN 'published' WHEN l.quality = 0 THEN 'draft' END AS status,
    '' AS image, '/notes/' || CAST(d.doc_id AS VARCHAR) AS url,
    CASE WHEN l.toxic = 1 THEN '' ELSE 'Open' END AS linkText,
    list_filter([d.source, CASE WHEN l.quality = 1 THEN 'featured' END], lambda g: g IS NOT NULL) AS groups,
    d.text AS content_raw
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
posts AS (SELECT pos, doc_id, {STRIP.format(x="coalesce(title, '')")} AS title, {STRIP.format(x="coalesce(summary, '')")} AS summary,
    {STRIP.format(x="coalesce(topic, '')")} AS topic, {STRIP.format(x="coalesce(category, '')")} AS category,
    {STRIP.format(x="coalesce(read, '')")} AS read, {STRIP.format(x="coalesce(status, '')")} AS status,
    CASE WHEN {STRIP.format(x="coalesce(linkText, '')")} = '' THEN 'Read note' ELSE {STRIP.format(x="coalesce(linkText, '')")} END AS linkText,
    CASE WHEN len(groups) = 0 THEN ['recent'] ELSE groups END AS groups,
    list_filter(list_transform(string_split_regex(coalesce(content_raw, ''), '\\n{WSQ}*\\n'), lambda s: {STRIP.format(x='s')}), lambda s: s <> '') AS content
  FROM form)"""


@register("normalize_posts", ops=("B-10",), sql=W(FORM_CTE) + "SELECT doc_id, title, summary, linkText, groups, content FROM posts")
def normalize_posts(spark, sf_dir):
    return posts(spark, sf_dir).select("doc_id", "title", "summary", "linkText", "groups", "content")


@register("validate_posts", ops=("B-11",), sql=W(FORM_CTE) + "SELECT doc_id FROM posts WHERE title <> '' AND summary <> ''")
def validate_posts(spark, sf_dir):
    return P.validate_posts(posts(spark, sf_dir)).select("doc_id")


@register("filter_posts", ops=("B-12",), sql=W(FORM_CTE) + """
SELECT doc_id FROM posts WHERE list_contains(string_split_regex(array_to_string(groups, ' '), '\\s+'), 'featured') AND topic = 'en'""")
def filter_posts(spark, sf_dir):
    return P.filter_posts(posts(spark, sf_dir), "featured", "en").select("doc_id")


@register("post_meta", ops=("B-13",), sql=W(FORM_CTE) + """
SELECT doc_id, concat_ws(' | ', CASE WHEN category <> '' THEN 'category: ' || category END,
                         CASE WHEN read <> '' THEN 'read: ' || read END,
                         CASE WHEN status <> '' THEN 'status: ' || status END) AS meta FROM posts""")
def post_meta(spark, sf_dir):
    return P.post_meta(posts(spark, sf_dir)).select("doc_id", "meta")


@register("post_meta_admin", ops=("B-13",), sql=W(FORM_CTE) + """
SELECT doc_id, concat_ws(' \u00b7 ', CASE WHEN topic <> '' THEN topic ELSE 'topic' END, CASE WHEN category <> '' THEN category ELSE 'category' END,
                         CASE WHEN read <> '' THEN read ELSE 'read' END, CASE WHEN status <> '' THEN status ELSE 'status' END,
                         CASE WHEN doc_id % 3 = 0 THEN 'image' ELSE 'no-image' END) AS meta FROM posts""")
def post_meta_admin(spark, sf_dir):
    p = posts(spark, sf_dir).withColumn("image", F.when(F.col("doc_id") % 3 == 0, "cover.png").otherwise(""))
    return P.admin_meta(p).select("doc_id", "meta")


@register("parse_read_minutes", ops=("B-14",), sql=W(FORM_CTE) + """
SELECT doc_id, read, TRY_CAST(regexp_extract(read, '^(\\d+)m$', 1) AS INTEGER) AS read_minutes FROM posts""")
def parse_read_minutes(spark, sf_dir):
    return P.read_minutes(posts(spark, sf_dir)).select("doc_id", "read", "read_minutes")


@register("extract_hashtags", ops=("B-15",), sql="""
SELECT doc_id, unnest(regexp_extract_all(text || ' hashtag#' || source || CASE WHEN lang = 'en' THEN ', hashtag#lang_en!' ELSE ' hashtag #no' END, 'hashtag#(\\w+)', 1)) AS hashtag FROM documents""")
def extract_hashtags(spark, sf_dir):
    # tags made from the source and, for English, the language
    d = tables(spark, sf_dir).documents
    tags = F.concat(F.lit(" hashtag#"), "source", F.when(F.col("lang") == "en", ", hashtag#lang_en!").otherwise(" hashtag #no"))
    return P.extract_hashtags(d.withColumn("text", F.concat("text", tags)), "doc_id", "text")


@register("prepend_posts", ops=("F-5",), sql=W(FORM_CTE) + """,
base AS (SELECT doc_id, pos FROM posts WHERE status <> ''),
new AS (SELECT doc_id, pos FROM posts WHERE status = '')
SELECT doc_id, CAST((SELECT min(pos) FROM base) - 1 - ((SELECT max(pos) FROM new) - pos) AS BIGINT) AS pos FROM new
UNION ALL SELECT doc_id, pos FROM base""")
def prepend_posts(spark, sf_dir):
    p = posts(spark, sf_dir).select("doc_id", "pos", "status")
    base = p.filter(F.col("status") != "").drop("status")
    new = p.filter(F.col("status") == "").drop("status")
    return P.prepend(base, new)


@register("posts_file", ops=("A-3", "A-4"), sql=W(FORM_CTE) + """
SELECT CAST(row_number() OVER (ORDER BY pos DESC) - 1 AS BIGINT) AS pos, title, topic, category, read, status, summary, url, linkText, groups
FROM form""")
def posts_file(spark, sf_dir):
    """Posts written as JSON lines, newest first, and read back with their positions."""
    path = new_folder(spark, "posts")
    form = form_data(spark, sf_dir)
    files.export_posts(form.select(*[c for c in form.columns if not c.endswith("_raw") and c not in ("doc_id", "pos")],
                                   (-F.col("pos")).alias("pos")), path)
    return files.read_posts(spark, path).select("pos", "title", "topic", "category", "read", "status", "summary", "url", "linkText", "groups")


@register("sitemap_file", ops=("A-6",), sql="""
SELECT url AS loc, round(1 / len(string_split(url, '/')), 3) AS priority FROM pages""")
def sitemap_file(spark, sf_dir):
    """Page addresses, the shallower the higher their priority, written as a sitemap and read back."""
    path = new_folder(spark, "sitemap")
    depth = F.size(F.split("url", "/"))
    files.write_sitemap(tables(spark, sf_dir).pages.select(F.col("url").alias("loc"), F.round(1 / depth, 3).alias("priority")), path)
    return files.read_sitemap(spark, path)

"""Link and path queries over ``pages``.

Binding (chosen here): the links are the anchors of the pages plus links made
from the table's own urls; the "sitemap" is every link with a path on its
page's host, made absolute; a listed location is dead when no page has that
host and canonical path.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import links as LK
from tessera.plans import bindings as B
from tessera.plans.common import tables
from tessera.plans.registry import register

W = B.with_ctes

PATH_SQL = f"regexp_extract({{u}}, '{LK.PATH_RE}', 1)"
QUERY_SQL = f"regexp_extract({{u}}, '{LK.QUERY_RE}', 1)"
HASH_SQL = f"regexp_extract({{u}}, '{LK.HASH_RE}', 1)"
HOST_SQL = f"lower(regexp_extract({{u}}, '{LK.HOST_RE}', 1))"


def canon_path_sql(u):
    p = PATH_SQL.format(u=u)
    clean = (f"CASE WHEN regexp_matches({p}, '(?i)/index\\.html$') THEN regexp_replace({p}, '(?i)/index\\.html$', '/') "
             f"WHEN regexp_matches({p}, '(?i)\\.html$') THEN regexp_replace({p}, '(?i)\\.html$', '') END")
    lead = f"CASE WHEN ({clean}) IS NULL THEN NULL WHEN starts_with({clean}, '/') THEN {clean} ELSE '/' || {clean} END"
    fix = f"CASE WHEN ({lead}) = '' THEN '/' ELSE {lead} END"
    return f"coalesce({fix}, {p})"


@register("canonical_path", ops=("B-16",), sql=f"""
SELECT page_id, url, {canon_path_sql('url')} || {QUERY_SQL.format(u='url')} || {HASH_SQL.format(u='url')} AS canonical
FROM pages""")
def canonical_path(spark, sf_dir):
    p = tables(spark, sf_dir).pages
    return p.select("page_id", "url", LK.canonical_url(F.col("url")).alias("canonical"))


@register("resolve_path", ops=("B-17",), sql=f"""
WITH x AS (SELECT page_id, url, regexp_replace({PATH_SQL.format(u='url')}, '/+$', '') AS t FROM pages)
SELECT page_id, url, CASE WHEN t = '' OR t = '/' THEN '/' WHEN NOT regexp_matches(t, '(?i)\\.[a-z0-9]+$') THEN t || '.html'
                          ELSE '/' END || {QUERY_SQL.format(u='url')} || {HASH_SQL.format(u='url')} AS resolved
FROM x""")
def resolve_path(spark, sf_dir):
    p = tables(spark, sf_dir).pages
    return p.select("page_id", "url", LK.resolve_path(F.col("url")).alias("resolved"))


RE_SQL = LK.HREF_RE.replace("'", "''")
ANCHORS_CTE = f"""q AS (SELECT page_id, url, list_transform(regexp_extract_all(html, '{RE_SQL}', 1), lambda h: substr(h, 2, length(h) - 2)) AS hrefs FROM pages),
a0 AS (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS anchor_no FROM q),
more AS (SELECT p.page_id, p.url, [p.url, n.url, 'http:///' || CAST(p.page_id AS VARCHAR), 'mailto:desk@' || CAST(p.page_id AS VARCHAR) || '.example',
           '#top', './note-' || CAST(p.page_id AS VARCHAR), 'tel:' || CAST(p.page_id AS VARCHAR), ' javascript:void(0)', 'files/a.pdf', 'sub/', ''] AS hrefs
         FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1),
a AS (SELECT page_id, url, href, anchor_no FROM a0
      UNION ALL SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 + 1000 AS anchor_no FROM more)"""


def _anchors(spark, sf_dir):
    """The anchors of every page and, numbered from 1000, links made from the
    table's own urls: the page itself, the next page, and one of each odd kind."""
    p = tables(spark, sf_dir).pages
    nxt = p.select((F.col("page_id") - 1).alias("_id"), F.col("url").alias("_next"))
    pid = F.col("page_id").cast("string")
    hrefs = F.array(F.col("url"), F.col("_next"), F.concat(F.lit("http:///"), pid), F.concat(F.lit("mailto:desk@"), pid, F.lit(".example")),
                    F.lit("#top"), F.concat(F.lit("./note-"), pid), F.concat(F.lit("tel:"), pid), F.lit(" javascript:void(0)"),
                    F.lit("files/a.pdf"), F.lit("sub/"), F.lit(""))
    more = p.select("page_id", "url").join(nxt, F.col("page_id") == F.col("_id"), "left")
    more = more.select("page_id", "url", F.posexplode(hrefs).alias("anchor_no", "href")).withColumn("anchor_no", F.col("anchor_no") + 1000)
    return LK.anchors(p).unionByName(more)


@register("classify_links", ops=("B-18",), sql=W(ANCHORS_CTE) + f"""
SELECT page_id, anchor_no, href, CASE
  WHEN href IS NULL OR href = '' OR starts_with(href, '#') OR starts_with(href, '/') OR starts_with(href, 'mailto:') OR starts_with(href, 'tel:') THEN 'skipped'
  WHEN lower(regexp_extract(href, '{LK.SCHEME_RE}', 1)) IN ('http', 'https') AND {HOST_SQL.format(u='href')} = '' THEN 'malformed'
  WHEN lower(regexp_extract(href, '{LK.SCHEME_RE}', 1)) IN ('http', 'https') AND {HOST_SQL.format(u='href')} <> {HOST_SQL.format(u='url')} THEN 'external'
  ELSE 'internal' END AS link_kind
FROM a""")
def classify_links(spark, sf_dir):
    a = _anchors(spark, sf_dir)
    return LK.classify_links(a).select("page_id", "anchor_no", "href", "link_kind")


@register("routable_links", ops=("B-19",), sql=W(ANCHORS_CTE) + """,
r AS (SELECT page_id, anchor_no, href, trim(href) AS raw FROM a),
f AS (SELECT *, NOT (raw IS NULL OR raw = '' OR raw = '/' OR contains(raw, '/#') OR starts_with(raw, '#') OR starts_with(raw, '/#')
                     OR starts_with(raw, 'mailto:') OR starts_with(raw, 'tel:') OR starts_with(raw, 'javascript:'))
                AND NOT (regexp_matches(raw, '(?i)^https?://') OR contains(raw, '.') OR ends_with(raw, '/')) AS routable FROM r)
SELECT page_id, anchor_no, href, routable,
       CASE WHEN routable THEN (CASE WHEN starts_with(raw, '/') THEN raw ELSE '/' || regexp_replace(raw, '^\\.?/', '') END) || '.html' END AS route_target
FROM f""")
def routable_links(spark, sf_dir):
    a = _anchors(spark, sf_dir)
    return LK.routable_links(a).select("page_id", "anchor_no", "href", "routable", "route_target")


INTERNAL_SQL = f"""starts_with(href, '/') OR (lower(regexp_extract(href, '{LK.SCHEME_RE}', 1)) IN ('http', 'https')
  AND {HOST_SQL.format(u='href')} = {HOST_SQL.format(u='url')})"""


@register("dead_links", ops=("C-8",), sql=W(ANCHORS_CTE) + f""",
listed AS (SELECT page_id, anchor_no, CASE WHEN starts_with(href, '/') THEN 'https://' || {HOST_SQL.format(u='url')} || href ELSE href END AS loc
           FROM a WHERE {INTERNAL_SQL}),
pk AS (SELECT DISTINCT {HOST_SQL.format(u='url')} || {canon_path_sql('url')} AS k FROM pages)
SELECT page_id, anchor_no, loc FROM listed
WHERE {HOST_SQL.format(u='loc')} || {canon_path_sql('loc')} NOT IN (SELECT k FROM pk)""")
def dead_links(spark, sf_dir):
    """Links with a path on the page's own host: rooted ones and absolute ones."""
    host = F.lower(F.regexp_extract(F.col("url"), LK.HOST_RE, 1))
    own = F.lower(F.regexp_extract(F.col("href"), LK.SCHEME_RE, 1)).isin("http", "https") & (F.lower(F.regexp_extract(F.col("href"), LK.HOST_RE, 1)) == host)
    a = _anchors(spark, sf_dir).filter(F.col("href").startswith("/") | own)
    loc = F.when(F.col("href").startswith("/"), F.concat(F.lit("https://"), host, F.col("href"))).otherwise(F.col("href"))
    return LK.dead_links(a.select("page_id", "anchor_no", loc.alias("loc")), tables(spark, sf_dir).pages, "loc", "url")

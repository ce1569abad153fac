"""URL paths and page links (B-16 .. B-19, C-8).

All rules are regex column functions, so a page corpus is processed as one
distributed projection plus an ``explode`` of its anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# URL pieces and the href prefixes that are never routed.
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)"
QUERY_RE = r"^[^?#]*(\?[^#]*)"
HASH_RE = r"(#.*)$"
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)"
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# an <a> tag up to its quoted href; attribute values before it may hold anything
HREF_RE = r"""(?i)<a(?:[ \t\r\n\f]+[a-z0-9-]+(?:=(?:"[^"]*"|'[^']*'|[^ \t\r\n\f"'>]*))?)*?[ \t\r\n\f]+href=("[^"]*"|'[^']*')"""
NO_ROUTE_PREFIXES = ("#", "/#", "mailto:", "tel:", "javascript:")
SKIP_PREFIXES = ("#", "/", "mailto:", "tel:")


def url_parts(url: Column):
    """(path, query incl. '?', hash incl. '#') of a URL or path."""
    return (F.regexp_extract(url, PATH_RE, 1), F.regexp_extract(url, QUERY_RE, 1),
            F.regexp_extract(url, HASH_RE, 1))


def canonical_path(url: Column) -> Column:
    """Pretty URL (B-16): ``/index.html`` -> ``/``, else ``.html`` dropped
    (case-insensitive); a changed path gets a leading '/', query and hash
    are kept. An unchanged path is returned as it is."""
    path, query, hsh = url_parts(url)
    is_index = path.rlike(r"(?i)/index\.html$")
    is_html = path.rlike(r"(?i)\.html$")
    clean = F.when(is_index, F.regexp_replace(path, r"(?i)/index\.html$", "/")) \
        .when(is_html, F.regexp_replace(path, r"(?i)\.html$", ""))
    clean = F.when(clean.isNull(), None).when(clean.startswith("/"), clean).otherwise(F.concat(F.lit("/"), clean))
    clean = F.when(clean == "", F.lit("/")).otherwise(clean)
    return F.when(clean.isNull(), path).otherwise(clean), query, hsh


def canonical_url(url: Column) -> Column:
    p, q, h = canonical_path(url)
    return F.concat(p, q, h)


def resolve_path(url: Column) -> Column:
    """Not-found fallback (B-17): trailing slashes stripped; empty -> '/';
    no extension -> ``path + '.html'``; anything else -> '/'. Query and
    hash are kept."""
    path, query, hsh = url_parts(url)
    trimmed = F.regexp_replace(path, r"/+$", "")
    target = (F.when((trimmed == "") | (trimmed == "/"), F.lit("/"))
              .when(~trimmed.rlike(r"(?i)\.[a-z0-9]+$"), F.concat(trimmed, F.lit(".html")))
              .otherwise(F.lit("/")))
    return F.concat(target, query, hsh)


def anchors(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The href of every ``<a>`` of every page, in either kind of quotes, with its position."""
    quoted = F.regexp_extract_all(F.col(html), F.lit(HREF_RE), 1)
    bare = F.transform(quoted, lambda h: F.substring(h, F.lit(2), F.char_length(h) - 2))
    return pages.select(page_id, url, F.posexplode(bare).alias("anchor_no", "href"))


def classify_links(links: DataFrame, href: str = "href", page_url: str = "url") -> DataFrame:
    """Per anchor (B-18): 'skipped' (empty, '#', '/', 'mailto:', 'tel:'),
    'malformed' (http(s) without a host), 'external' (http(s) to another
    host than the page's), else 'internal'."""
    h = F.col(href)
    skip = (h.isNull() | (h == ""))
    for p in SKIP_PREFIXES:
        skip = skip | h.startswith(p)
    scheme = F.lower(F.regexp_extract(h, SCHEME_RE, 1))
    is_http = scheme.isin("http", "https")
    host = F.lower(F.regexp_extract(h, HOST_RE, 1))
    page_host = F.lower(F.regexp_extract(F.col(page_url), HOST_RE, 1))
    kind = (F.when(skip, "skipped").when(is_http & (host == ""), "malformed")
            .when(is_http & (host != page_host), "external").otherwise("internal"))
    return links.withColumn("link_kind", kind)


def routable_links(links: DataFrame, href: str = "href") -> DataFrame:
    """Extensionless internal links and their ``.html`` target (B-19)."""
    raw = strip = F.trim(F.col(href))
    no_route = raw.isNull() | (raw == "") | (raw == "/") | raw.contains("/#")
    for p in NO_ROUTE_PREFIXES:
        no_route = no_route | raw.startswith(p)
    external_or_file = raw.rlike(r"(?i)^https?://") | raw.contains(".") | raw.endswith("/")
    path = F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit("/"), F.regexp_replace(strip, r"^\.?/", "")))
    return (links.withColumn("routable", ~no_route & ~external_or_file)
            .withColumn("route_target", F.when(F.col("routable"), F.concat(path, F.lit(".html")))))


def dead_links(listed: DataFrame, pages: DataFrame, listed_loc: str, page_loc: str) -> DataFrame:
    """Listed locations without a page (C-8): both sides canonicalised to
    lower-case host + pretty path (query and hash dropped), then a left
    anti join."""
    def key(c):
        return F.concat(F.lower(F.regexp_extract(F.col(c), HOST_RE, 1)), canonical_path(F.col(c))[0])
    ls = listed.withColumn("_k", key(listed_loc))
    pg = pages.select(key(page_loc).alias("_k")).distinct()
    return ls.join(pg, "_k", "left_anti").drop("_k")

"""The registered queries and their equivalents in SQL.

Every query runs over whole tables.  Where SQL cannot express one, it has no
entry in ``ORACLE`` and its tests compare it with known answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import http, patterns, urls
from ..operators import crawl, groups, inference, links, resources, revisions, rewrite, sql
from ..sources import bodies, layout, project, recorded, scratch
from ..streaming import changes
from ..streaming import membership as streaming
from . import model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
PATTERN = "https://blog.*.example.com/en/**"
HOST = "localhost:2797"


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLE[name or f.__name__] = oracle
        return f

    return register


def simple(name: str, oracle: str, f: Query) -> None:
    query(oracle, name)(f)


# Pieces of SQL that several oracles share.

R = "r AS (SELECT page_id AS id, url FROM pages)"


def _re(pattern: str) -> str:
    """An RE2 expression of a pattern, without the Java flags and escapes."""
    body = patterns.pattern_regex(pattern)[len("(?d)^") : -1]
    for c in "#~<>=!:,/& -":
        body = body.replace("\\" + c, c)
    return body


def _fits(url: str, pattern: str) -> str:
    return f"(starts_with({url}, '{patterns.literal_prefix(pattern)}') AND regexp_full_match({url}, '{_re(pattern)}'))"


def _g(only=lambda g: True) -> str:
    return "g AS (SELECT * FROM (VALUES " + ", ".join(f"({g.id}, '{g.name}', '{g.pattern}', '{_re(g.pattern)}', {str(g.do_not_download).lower()})" for g in model.GROUPS if only(g)) + ") AS t(group_id, name, pattern, re, dnd))"


G = _g()
_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in model.STATUS.items()) + " END"
REV = f"""rev AS (SELECT event_id AS id, user_id AS resource_id, CASE WHEN event_id % 3 = 0 THEN 'c' || (event_id % 7) END AS request_cookie,
  CASE WHEN event_type = 'error' THEN '{{"type":"IOError","message":"lost"}}' ELSE 'null' END AS error, {_STATUS} AS status_code,
  'e' || (CAST(props->>'$.k' AS BIGINT) % 5) AS etag, CAST(props->>'$.k' AS BIGINT) AS k, ts AS date FROM events)"""
_CT = """CASE k % 4 WHEN 0 THEN 'Text/HTML; Charset="utf-8"' WHEN 1 THEN 'text/css' WHEN 2 THEN 'application/json; charset=latin1' ELSE 'image/png' END"""
HEAD = f"""head AS (SELECT *, [['Content-Type', {_CT}], ['Date', strftime(date, '%a, %d %b %Y %H:%M:%S GMT')], ['AGE', CAST(k % 100 AS VARCHAR)], ['X-Unknown', '1'], ['ETag', etag]] AS headers FROM rev)"""


def _lit(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


_SCHEME, _HOST = "regexp_extract({u}, '^([a-zA-Z]+)://', 1)", "regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)"


def _host(u: str) -> str:
    return f"regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)"


def _path(u: str) -> str:
    return f"regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"


LINKS = """found AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)', 2) AS texts FROM pages),
lk AS (SELECT page_id, url, i - 1 AS pos, replace(hrefs[i], '&amp;', '&') AS relative_url, 'Link' AS type_title, replace(replace(texts[i], '&amp;', '&'), '&quot;', '"') AS title FROM found, unnest(range(1, len(hrefs) + 1)) AS u(i)),
tl AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || relative_url AS target_url FROM lk)"""


# Lookups, scans, patterns


simple("scan_resources", f"WITH {R} SELECT id, url FROM r", lambda s, d: resources.scan(model.resources(s, d)))
simple("point_lookup_url", f"WITH {R} SELECT id, url FROM r WHERE url = 'http://therha.example.com/en/676'", lambda s, d: resources.by_url(model.resources(s, d), "http://therha.example.com/en/676"))
simple("lookup_id", f"WITH {R} SELECT id, url FROM r WHERE id = 17", lambda s, d: resources.by_id(model.resources(s, d), 17))
simple("pattern_members", f"WITH {R} SELECT id, url FROM r WHERE {_fits('url', PATTERN)} ORDER BY id", lambda s, d: groups.members(model.resources(s, d), PATTERN).orderBy("id"))
simple("pattern_literal", f"WITH {R} SELECT id, url FROM r WHERE url = 'http://ththed.example.org/en/453#top'", lambda s, d: groups.members(model.resources(s, d), "http://ththed.example.org/en/453").union(resources.by_url(model.resources(s, d), "http://ththed.example.org/en/453#top")))
simple("pattern_urls_limit", f"WITH {R} SELECT url FROM r WHERE {_fits('url', 'http**')} ORDER BY url LIMIT 20", lambda s, d: groups.members(model.resources(s, d), "http**").select("url").orderBy("url").limit(20))
simple("pattern_prefix_count", f"WITH {R} SELECT count(*) AS n FROM r WHERE starts_with(url, 'https://blog.')", lambda s, d: groups.prefix_count(model.resources(s, d), "https://blog.*/en/#"))
simple(
    "pattern_preview",
    f"""WITH {R}, m AS (SELECT url FROM r WHERE {_fits('url', 'https://**')} ORDER BY url LIMIT 11), top AS (SELECT url FROM m ORDER BY url LIMIT 10)
    SELECT url, CAST(NULL AS BIGINT) AS more FROM top UNION ALL
    SELECT NULL, (SELECT count(*) FROM r WHERE starts_with(url, 'https://')) - 10 WHERE (SELECT count(*) FROM m) > 10""",
    lambda s, d: groups.preview(model.resources(s, d), "https://**", 10),
)
simple("group_membership", f"WITH {R}, {G} SELECT r.id, r.url, CAST(group_id AS BIGINT) AS group_id FROM r JOIN g ON regexp_full_match(r.url, g.re)", lambda s, d: groups.membership(model.resources(s, d), model.GROUPS))
simple("group_membership_by_table", ORACLE["group_membership"], lambda s, d: groups.membership_by_table(model.resources(s, d), groups.group_table(s, model.GROUPS)))


@query(
    f"""WITH {R}, many AS (SELECT event_id AS group_id, 'https://%/' || ['en', 'fr', 'es', 'de'][event_id % 4 + 1] || '/' || event_id // 4 % 1000 || ['', '%', '/', '.html'][event_id % 3 + 1] AS fits FROM events)
    SELECT id, url, group_id FROM r JOIN many ON url LIKE fits"""
)
def many_patterns_membership(s, d):
    """A group for every event, all of one literal prefix: pages of a language and number, with or without what follows."""
    k = F.col("event_id")
    lang, tail = (F.element_at(F.array(*map(F.lit, of)), (k % n + 1).cast("int")) for of, n in ((("en", "fr", "es", "de"), 4), (("", "**", "/"), 3)))
    pattern = F.concat(F.lit("https://**/"), lang, F.lit("/"), F.expr("event_id div 4 % 1000").cast("string"), tail)
    many = model.table(s, d, "events").select(k.alias("group_id"), pattern.alias("url_pattern")).withColumn("regex", patterns.regex_of(F.col("url_pattern")))
    return groups.membership_by_table(model.resources(s, d), many)


simple("group_member_counts", f"WITH {R}, {G} SELECT CAST(group_id AS BIGINT) AS group_id, name, count(r.id) AS n_members FROM g LEFT JOIN r ON regexp_full_match(r.url, g.re) GROUP BY ALL", lambda s, d: groups.member_counts(model.resources(s, d), model.GROUPS))
simple("groups_per_url", f"WITH {R}, {G} SELECT r.id, count(group_id) AS n_groups FROM r LEFT JOIN g ON regexp_full_match(r.url, g.re) GROUP BY r.id", lambda s, d: model.resources(s, d).select("id", F.size(groups.fitting(F.col("url"), model.GROUPS)).cast("long").alias("n_groups")))
simple("dnd_filtered", f"WITH {R}, {G} SELECT id, url FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE dnd AND regexp_full_match(r.url, g.re))", lambda s, d: groups.without_do_not_download(model.resources(s, d), model.GROUPS))
_GEN = "length(regexp_replace(pattern, '[^*]', '', 'g'))"


@query(f"""WITH {R}, {G}, gen AS (SELECT *, len(regexp_extract_all(pattern, '\\*\\*')) AS a, len(regexp_extract_all(replace(pattern, '**', ''), '\\*')) AS b, len(regexp_extract_all(pattern, '[#@]')) AS c,
  -length(regexp_replace(replace(pattern, '*', ''), '[#@]', '', 'g')) AS e FROM g)
SELECT r.id, (SELECT CAST(group_id AS BIGINT) FROM gen WHERE regexp_full_match(r.url, re) ORDER BY a, b, c, e, group_id LIMIT 1) AS group_id FROM r""")
def narrowest_group(s, d):
    return groups.narrowest(model.resources(s, d), model.GROUPS).select("id", "group_id")


@query(f"""WITH {G} SELECT CAST(group_id AS BIGINT) AS group_id, CAST(len(regexp_extract_all(pattern, '\\*\\*')) AS INT) AS star_star, CAST(len(regexp_extract_all(replace(pattern, '**', ''), '\\*')) AS INT) AS star,
  CAST(len(regexp_extract_all(pattern, '[#@]')) AS INT) AS mark, CAST(-length(regexp_replace(replace(pattern, '*', ''), '[#@]', '', 'g')) AS INT) AS minus_literal FROM g""")
def genericity(s, d):
    return groups.group_table(s, model.GROUPS).withColumn("g", patterns.genericity(F.col("url_pattern"))).select("group_id", "g.star_star", "g.star", "g.mark", "g.minus_literal")


def _badges(s, d):
    rev = model.revisions(s, d)
    latest = revisions.newest(rev).select(F.col("resource_id").alias("id"), F.col("id").alias("revision_id"), "error", "headers", "request_cookie", "status_code")
    joined = model.resources(s, d).join(latest, "id", "left")
    stale = http.is_stale(F.col("url"), F.col("request_cookie"), http.date_plus_age(F.col("headers")), min_fetch_date=F.lit(model.MIN_FETCH).cast("timestamp"))
    badge = groups.status_badge(F.col("url"), model.GROUPS, F.col("revision_id"), stale, http.has_error(F.col("error")) | http.is_error_page(F.col("status_code")))
    return joined.select("id", badge.alias("badge"))


simple(
    "status_badge",
    f"""WITH {R}, {G}, {REV}, last AS (SELECT resource_id, arg_max(id, id) AS revision_id, arg_max(error, id) AS error, arg_max(status_code, id) AS st, arg_max(date_trunc('second', date) + to_seconds(k % 100), id) AS fetched FROM rev GROUP BY 1)
    SELECT r.id, CASE WHEN EXISTS (SELECT 1 FROM g WHERE dnd AND regexp_full_match(r.url, re)) AND NOT EXISTS (SELECT 1 FROM g WHERE NOT dnd AND regexp_full_match(r.url, re)) THEN 'dnd'
      WHEN revision_id IS NULL THEN 'new' WHEN fetched <= TIMESTAMP '{model.MIN_FETCH}' THEN 'stale' WHEN error = 'null' AND st // 100 NOT IN (4, 5) THEN 'ok' ELSE 'warning' END AS badge
    FROM r LEFT JOIN last ON r.id = last.resource_id""",
    _badges,
)


# Revisions


simple("default_revision", f"WITH {REV} SELECT id, resource_id, status_code FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY id DESC) AS n FROM rev) WHERE n = 1", lambda s, d: revisions.newest(model.revisions(s, d).select("id", "resource_id", "status_code")))


def _fresh(s, d):
    fetched = http.date_plus_age(F.col("headers"))
    stale = http.is_stale(F.lit(""), F.col("request_cookie"), fetched, min_fetch_date=F.lit(model.MIN_FETCH).cast("timestamp"))
    return revisions.newest(model.revisions(s, d), ~stale).select("id", "resource_id")


simple("default_fresh_revision", f"WITH {REV} SELECT max(id) AS id, resource_id FROM rev WHERE date_trunc('second', date) + to_seconds(k % 100) > TIMESTAMP '{model.MIN_FETCH}' GROUP BY resource_id", _fresh)
simple("latest3_ok", f"WITH {REV} SELECT id, resource_id FROM rev WHERE error = 'null' AND id < (SELECT max(id) FROM rev) ORDER BY id DESC LIMIT 3", lambda s, d: revisions.latest_ok(model.revisions(s, d).select("id", "resource_id", "error"), http.has_error(F.col("error"))).select("id", "resource_id"))
simple("revisions_of_resource", f"WITH {REV} SELECT id, status_code FROM rev WHERE resource_id = 7", lambda s, d: revisions.of_resource(model.revisions(s, d), 7).select("id", "status_code"))
simple("revision_with_url", f"WITH {R}, {REV} SELECT rev.id, url, status_code FROM rev JOIN r ON rev.resource_id = r.id", lambda s, d: model.revisions(s, d).join(model.resources(s, d).withColumnRenamed("id", "resource_id"), "resource_id").select("id", "url", "status_code"))
simple("has_revision_semi", f"WITH {R}, {REV} SELECT id, url FROM r WHERE id IN (SELECT resource_id FROM rev)", lambda s, d: revisions.with_any(model.resources(s, d), model.revisions(s, d)))
simple("no_revision_anti", f"WITH {R}, {REV} SELECT id, url FROM r WHERE id NOT IN (SELECT resource_id FROM rev)", lambda s, d: revisions.without_any(model.resources(s, d), model.revisions(s, d)))
simple("etag_latest", f"WITH {REV} SELECT resource_id, etag, max(id) AS revision_id, count(*) AS n_revisions FROM rev WHERE status_code <> 304 AND etag IS NOT NULL GROUP BY ALL", lambda s, d: revisions.by_etag(model.revisions(s, d)))
simple(
    "resolve_304",
    f"""WITH {REV}, {HEAD}, t AS (SELECT resource_id, etag, max(id) AS target FROM rev WHERE status_code <> 304 AND etag IS NOT NULL GROUP BY ALL), p AS (SELECT h.*, CASE WHEN status_code = 304 THEN target END AS target FROM head h LEFT JOIN t USING (resource_id, etag))
    SELECT p.id, coalesce(p.target, p.id) AS target_id, CAST(len(p.headers) AS INT) AS n_headers, list_filter(p.headers, lambda h: lower(h[1]) = 'date')[1][2] AS served_date,
      list_filter(coalesce(b.headers, p.headers), lambda h: lower(h[1]) = 'age')[1][2] AS served_age FROM p LEFT JOIN head b ON b.id = p.target""",
    lambda s, d: revisions.resolve_not_modified(model.revisions(s, d)).select("id", "target_id", F.size("served_headers").alias("n_headers"), http.first_header(F.col("served_headers"), "date").alias("served_date"), http.first_header(F.col("served_headers"), "age").alias("served_age")),
)
simple(
    "fill_etag_304",
    f"""WITH {REV}, e AS (SELECT id, resource_id, status_code, CASE WHEN status_code = 304 THEN NULL WHEN resource_id % 2 = 0 THEN 'only' ELSE etag END AS etag FROM rev),
    o AS (SELECT resource_id, CASE WHEN count(DISTINCT etag) = 1 THEN min(etag) END AS only_ FROM e WHERE status_code <> 304 AND etag IS NOT NULL GROUP BY 1)
    SELECT id, CASE WHEN status_code = 304 AND etag IS NULL THEN only_ ELSE etag END AS etag FROM e LEFT JOIN o USING (resource_id)""",
    lambda s, d: revisions.fill_etag(model.revisions(s, d).withColumn("etag", F.when(F.col("status_code") == 304, F.lit(None)).when(F.col("resource_id") % 2 == 0, "only").otherwise(F.col("etag")))).select("id", "etag"),
)
simple("status_class_counts", f"WITH {REV} SELECT CAST(status_code // 100 AS BIGINT) AS status_class, count(*) AS n FROM rev GROUP BY 1", lambda s, d: model.revisions(s, d).groupBy(F.floor(F.col("status_code") / 100).alias("status_class")).agg(F.count(F.lit(1)).alias("n")))
simple("error_revisions", f"WITH {REV} SELECT id, error->>'$.type' AS error_type FROM rev WHERE error <> 'null'", lambda s, d: model.revisions(s, d).where(http.has_error(F.col("error"))).select("id", http.decode_error(F.col("error"))["type"].alias("error_type")))
simple("non200", f"WITH {REV} SELECT id, status_code FROM rev WHERE status_code <> 200", lambda s, d: model.revisions(s, d).where("status_code <> 200").select("id", "status_code"))
simple("is_redirect", f"WITH {REV} SELECT id, status_code // 100 = 3 AS redirect, status_code = 304 AS not_modified, status_code // 100 IN (4, 5) AS error_page FROM rev", lambda s, d: model.revisions(s, d).select("id", http.is_redirect(F.col("status_code")).alias("redirect"), http.is_not_modified(F.col("status_code")).alias("not_modified"), http.is_error_page(F.col("status_code")).alias("error_page")))
simple("has_cookie", f"WITH {REV} SELECT id, request_cookie FROM rev WHERE request_cookie IS NOT NULL", lambda s, d: model.revisions(s, d).where("request_cookie is not null").select("id", "request_cookie"))
simple("header_first_value", f"WITH {REV}, {HEAD} SELECT id, list_filter(headers, lambda h: lower(h[1]) = 'age')[1][2] AS age FROM head", lambda s, d: model.revisions(s, d).select("id", http.first_header(F.col("headers"), "Age").alias("age")))
simple("content_type", f"WITH {REV}, {HEAD} SELECT id, lower(trim(split_part(headers[1][2], ';', 1))) AS content_type, nullif(replace(regexp_extract(headers[1][2], '(?i)charset=(.*)$', 1), '\"', ''), '') AS charset, CASE k % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'css' WHEN 2 THEN 'json' END AS kind, k % 4 = 3 AS binary FROM head", lambda s, d: model.revisions(s, d).withColumn("content_type", http.content_type(F.col("headers"), F.lit("x"))).select("id", "content_type", http.declared_charset(F.col("headers")).alias("charset"), http.document_kind(F.col("content_type")).alias("kind"), http.is_binary(F.col("content_type")).alias("binary")))
simple("date_plus_age", f"WITH {REV} SELECT id, date_trunc('second', date) + to_seconds(k % 100) AS fetched FROM rev", lambda s, d: model.revisions(s, d).select("id", http.date_plus_age(F.col("headers")).cast("timestamp_ntz").alias("fetched")))
simple("header_allowlist", f"WITH {REV}, {HEAD} SELECT id, array_to_string(list_transform(list_filter(headers, lambda h: lower(h[1]) IN ({_lit(http.ALLOWED_HEADERS)})), lambda h: h[1]), ',') AS names FROM head", lambda s, d: model.revisions(s, d).select("id", F.array_join(F.transform(http.playable(F.col("headers")), lambda h: h[0]), ",").alias("names")))
simple("replace_content_type", f"WITH {REV}, {HEAD} SELECT id, 'text/plain' AS content_type, CAST(len(headers) AS INT) AS n FROM head", lambda s, d: model.revisions(s, d).withColumn("h", http.replace_header(F.col("headers"), "content-type", F.lit("text/plain"))).select("id", http.first_header(F.col("h"), "content-type").alias("content_type"), F.size("h").alias("n")))
simple("auto_date", f"WITH {REV} SELECT id, 'Wed, 16 Aug 2023 00:00:00 GMT' AS date FROM rev", lambda s, d: model.revisions(s, d).select("id", http.first_header(http.with_date(F.array(F.array(F.lit("Server"), F.lit("x"))), F.lit("2023-08-16 00:00:00").cast("timestamp")), "date").alias("date")))
simple("cache_control", f"WITH {R} SELECT id, CASE WHEN contains(substr(p, 2), '/') THEN 'max-age=3600' ELSE 'max-age=0, must-revalidate' END AS policy FROM (SELECT id, {_path('url')} AS p FROM r)", lambda s, d: model.resources(s, d).select("id", http.cache_control(urls.path(F.col("url"))).alias("policy")))
simple("distinct_cookies_recent", f"WITH {REV} SELECT request_cookie, max(id) AS last_id FROM rev WHERE request_cookie IS NOT NULL GROUP BY 1", lambda s, d: revisions.cookies_by_recency(model.revisions(s, d)))
simple("approx_max_id", f"WITH {R} SELECT max(id) AS approx_rows FROM r", lambda s, d: model.resources(s, d).agg(F.max("id").alias("approx_rows")))
simple("min_max_id", f"WITH {REV} SELECT min(id) AS lo, max(id) AS hi, count(*) AS n FROM rev", lambda s, d: model.revisions(s, d).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")))
simple(
    "stale_revisions",
    f"""WITH {R}, {REV} SELECT rev.id, (starts_with(url, 'https://www.example.com/') AND request_cookie IS DISTINCT FROM 'c1') OR coalesce(date_trunc('second', date) + to_seconds(k % 100) <= TIMESTAMP '{model.MIN_FETCH}', false) AS stale FROM rev JOIN r ON rev.resource_id = r.id""",
    lambda s, d: model.revisions(s, d).join(model.resources(s, d).withColumnRenamed("id", "resource_id"), "resource_id").select("id", http.is_stale(F.col("url"), F.col("request_cookie"), http.date_plus_age(F.col("headers")), "c1", "https://www.example.com", F.lit(model.MIN_FETCH).cast("timestamp")).alias("stale")),
)
simple("metadata_json", f"WITH {REV} SELECT id, CAST(status_code AS INT) AS status_code, error = 'null' AS no_error FROM rev", lambda s, d: model.revisions(s, d).withColumn("json", http.encode(F.struct(F.lit(11).alias("http_version"), "status_code", F.lit("OK").alias("reason_phrase"), "headers"))).select("id", http.decode_metadata(F.col("json"))["status_code"].alias("status_code"), http.decode_error(F.col("error")).isNull().alias("no_error")))
simple("orphan_audit", f"WITH {REV}, b AS (SELECT id + 5 AS id FROM rev WHERE id % 2 = 0) SELECT id, 'missing body' AS problem FROM rev WHERE error = 'null' AND id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'missing revision' FROM b WHERE id NOT IN (SELECT id FROM rev)", lambda s, d: revisions.orphans(model.revisions(s, d), model.revisions(s, d).where("id % 2 = 0").select((F.col("id") + 5).alias("id"))))
simple("dangling_roots", "SELECT CAST(3 AS BIGINT) AS root_id, 'Lost' AS name, CAST(999999999 AS BIGINT) AS resource_id", lambda s, d: resources.dangling(model.roots(s), model.resources(s, d)))
simple("roots_with_url", f"WITH {R} SELECT root_id, url FROM r JOIN (VALUES (1, 2), (2, 10)) AS t(root_id, resource_id) ON id = resource_id", lambda s, d: resources.with_url(model.roots(s), model.resources(s, d)).select(F.col("root_id").cast("int").alias("root_id"), "url"))
simple("deletable_resources", f"WITH {R} SELECT id, url FROM r WHERE id NOT IN (2, 10)", lambda s, d: resources.deletable(model.resources(s, d), model.roots(s)))
simple("property_default", "SELECT CASE WHEN count(*) = 0 THEN 'fallback' ELSE min(url) END AS value FROM pages WHERE page_id = 3 AND page_id % 2 = 0", lambda s, d: resources.property_value(model.resources(s, d).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 2 == 0, F.col("url")).otherwise("").alias("value")), "p3", "fallback"))


# URLs


def _of(f) -> Query:
    return lambda s, d: model.resources(s, d).select("id", f(F.col("url")))


simple("strip_fragment", f"WITH {R} SELECT id, regexp_replace(url, '#.*$', '') AS out FROM r", _of(lambda u: urls.strip_fragment(u).alias("out")))
simple("lower_host", f"WITH {R} SELECT id, url AS out FROM r", lambda s, d: model.resources(s, d).select("id", urls.lower_host(F.concat(F.regexp_extract("url", "^([a-z]+://)", 1), F.upper(urls.netloc(F.col("url"))), F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1))).alias("out")))
simple("root_slash", f"WITH {R} SELECT id, {_SCHEME.format(u='url')} || '://' || {_host('url')} || '/' AS out FROM r", lambda s, d: model.resources(s, d).select("id", urls.root_slash(urls.domain_prefix(F.col("url"))).alias("out")))
simple("url_parts", f"WITH {R} SELECT id, {_SCHEME.format(u='url')} AS scheme, {_host('url')} AS netloc, {_path('url')} AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM r", lambda s, d: model.resources(s, d).select("id", urls.scheme(F.col("url")).alias("scheme"), urls.netloc(F.col("url")).alias("netloc"), urls.path(F.col("url")).alias("path"), urls.query(F.col("url")).alias("query"), urls.fragment(F.col("url")).alias("fragment")))
simple("domain_prefix", f"WITH {R} SELECT id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS out FROM r", _of(lambda u: urls.domain_prefix(u).alias("out")))
simple("dir_prefix", f"WITH {R} SELECT id, regexp_extract(url, '^([a-z]+://[^/?#]*(?:/[^/?#]*)*)/[^/?#]*', 1) || regexp_extract(url, '([?#].*)$', 1) AS out FROM r", _of(lambda u: urls.directory_prefix(u).alias("out")))
simple("display_url", f"WITH {R} SELECT id, CASE WHEN starts_with(url, 'https://m.ththth.example.net/') THEN substr(url, 29) ELSE url END AS out FROM r", _of(lambda u: urls.display(u, "https://m.ththth.example.net").alias("out")))
_REQ = f"'http://{HOST}/_/' || regexp_replace(url, '^([a-z]+)://', '\\1/')"
simple("request_url", f"WITH {R} SELECT id, CASE WHEN starts_with(url, 'https://m.ththth.example.net/') THEN 'http://{HOST}' || substr(url, 29) ELSE {_REQ} END AS out FROM r", _of(lambda u: urls.request_url(u, HOST, "https://m.ththth.example.net").alias("out")))
simple("archive_url", f"WITH {R} SELECT id, url AS out FROM r", _of(lambda u: urls.archive_url(F.concat(F.lit("/_/"), F.regexp_replace(u, "://", "/"))).alias("out")))
simple("external_url", f"WITH {R} SELECT id, 'archive://external/' || url AS external, url AS back FROM r", _of(lambda u: F.struct(urls.format_external(u).alias("external"), urls.parse_external(urls.format_external(u)).alias("back")).alias("x")))
QUERIES["external_url"] = lambda s, d: model.resources(s, d).select("id", urls.format_external(F.col("url")).alias("external"), urls.parse_external(urls.format_external(F.col("url"))).alias("back"))
simple("unrewritable_urls", f"WITH {R} SELECT id, id % 3 <> 2 AS unrewritable FROM r", lambda s, d: model.resources(s, d).select("id", urls.is_unrewritable(F.concat(F.get(F.array(F.lit("mailto:"), F.lit("javascript:"), F.lit("Mailto:")), (F.col("id") % 3).cast("int")), F.col("url"))).alias("unrewritable")))
simple("cookie_applies", f"WITH {R} SELECT id, starts_with(url, 'https://m.ththth.example.net/') AS applies FROM r", _of(lambda u: urls.cookie_applies(u, "https://m.ththth.example.net").alias("applies")))
simple("normalize_url", f"WITH {R} SELECT id, regexp_replace(url, '#.*$', '') AS normal FROM r", lambda s, d: urls.with_alternatives(model.resources(s, d)).select("id", urls.normal_form(F.col("alternatives")).alias("normal")))
simple("url_alternatives", f"WITH {R} SELECT id, CAST(unnest([0, 1]) AS INT) AS pos, unnest([url, regexp_replace(url, '#.*$', '')]) AS alternative FROM r WHERE contains(url, '#') UNION ALL SELECT id, 0, url FROM r WHERE NOT contains(url, '#')", lambda s, d: urls.with_alternatives(model.resources(s, d)).select("id", F.posexplode("alternatives").alias("pos", "alternative")))


_SITE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


def _made(expression: str, f) -> Query:
    """A URL function over URLs that an SQL expression makes from every page's id and URL."""
    return lambda s, d: model.resources(s, d).select("id", f(F.expr(expression)).alias("out"))


def _by_id(cases: list[str]) -> str:
    return f"CASE id % {len(cases)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


_START = "(id * 7 % 200)"
_SID = "substr(md5(CAST(id AS STRING)), 1, 32)"
FORUM = [
    f"{_SITE} || '/viewforum.php?f=' || id || '&start=' || {_START} || '&sid=0'",
    f"{_SITE} || '/viewtopic.php?p=9&t=' || id || '&start=' || {_START}",
    f"{_SITE} || '/memberlist.php?mode=viewprofile&u=' || id || '&x=1'",
    f"{_SITE} || '/memberlist.php?g=' || id || '&mode=group'",
    f"{_SITE} || '/f/index.php?a=b&sid=' || {_SID}",
    f"{_SITE} || '/viewforum.php?f=a'",
]


def _paged(size: int) -> str:
    return f"CASE WHEN {_START} >= {size} THEN '&start=' || ({_START} // {size} * {size}) ELSE '' END"


FORUM_OUT = [
    f"{_SITE} || '/viewforum.php?f=' || id || {_paged(25)}",
    f"{_SITE} || '/viewtopic.php?t=' || id || {_paged(20)}",
    f"{_SITE} || '/memberlist.php?mode=viewprofile&u=' || id",
    f"{_SITE} || '/memberlist.php?mode=group&g=' || id",
    f"{_SITE} || '/f/index.php?a=b&sid=' || md5(id::VARCHAR)",
    FORUM[5],
]
simple("phpbb_normalize", f"WITH {R} SELECT id, {_by_id(FORUM_OUT)} AS out FROM r", _made(_by_id(FORUM), urls.phpbb))
BLOG = [f"{_SITE} || '/post?replytocom=' || id", f"{_SITE} || '/post?replytocom=' || id || '/'", f"{_SITE} || '/?post_type=ngg%2F%2F'", f"{_SITE} || '/?p=' || id"]
BLOG_OUT = [f"{_SITE} || '/post'", f"{_SITE} || '/post'", f"{_SITE} || '/?post_type=ngg//'", BLOG[3]]
simple("wordpress_normalize", f"WITH {R} SELECT id, {_by_id(BLOG_OUT)} AS out FROM r", _made(_by_id(BLOG), urls.wordpress))
BAKER = ["'https://minimalistbaker.com/a' || id || '?tp_image_id=' || id", "'https://minimalistbaker.com/a' || id || '?omhide=true'", f"{_SITE} || '/a?omhide=true'"]
BAKER_OUT = ["'https://minimalistbaker.com/a' || id", "'https://minimalistbaker.com/a' || id", BAKER[2]]
simple("minbaker_normalize", f"WITH {R} SELECT id, {_by_id(BAKER_OUT)} AS out FROM r", _made(_by_id(BAKER), urls.minimalist_baker))
_EVENT = """concat('{"properties":{"browserSessionId":"s', id, '"},"context":{"page":{"referrer":"', url, '","url":"http://o.test/x', id, '"}}}')"""
_EVENT_OUT = f"""'{{"properties": {{"browserSessionId": "1xh68gok0s4"}}, "context": {{"page": {{"referrer": "", "url": "' || {_SITE} || '/x' || id || '"}}}}}}'"""
simple(
    "substack_normalize",
    f"""WITH {R} SELECT id, CASE WHEN id % 3 = 2 THEN {_SITE} || '/api/v1/firehose?_=a&d=' || id ELSE {_SITE} || '/api/v1/firehose?_=' || id || '&d=' ||
    replace(replace(replace(base64(encode({_EVENT_OUT})), '+', '-'), '/', '_'), '=', '%3D') END AS out FROM r""",
    _made(f"CASE WHEN id % 3 = 2 THEN {_SITE} || '/api/v1/firehose?_=a&d=' || id ELSE concat({_SITE}, '/api/v1/firehose?_=', id, '&d=', translate(base64(CAST({_EVENT} AS BINARY)), '+/', '-_')) END", urls.substack),
)
_HOSTS = "h AS (SELECT id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM r)"
_TWIN = "CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE 'www.' || host END"
simple(
    "user_input_candidates",
    f"""WITH {R}, {_HOSTS}, c AS (SELECT id, CASE id % 4 WHEN 0 THEN ['https://' || host || '/', 'https://' || {_TWIN} || '/', 'http://' || host || '/', 'http://' || {_TWIN} || '/']
    WHEN 1 THEN ['https://www.' || host || '/about', 'https://' || host || '/about', 'http://www.' || host || '/about', 'http://' || host || '/about']
    WHEN 2 THEN [scheme || '://' || host || '/'] ELSE ['http://' || host || '/1/'] END AS made FROM h)
    SELECT id, CAST(pos - 1 AS INT) AS pos, made[pos] AS candidate FROM c, unnest(range(1, len(made) + 1)) AS u(pos)""",
    lambda s, d: model.resources(s, d).withColumn("host", F.lower(urls.netloc(F.col("url")))).select("id", F.posexplode(urls.candidates(F.expr("CASE id % 4 WHEN 0 THEN host WHEN 1 THEN 'www.' || host || '/about' WHEN 2 THEN split(url, '://')[0] || '://' || host ELSE ' http://' || host || '/1/#x ' END"))).alias("pos", "candidate")),
)
_AL = "al AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{a}', '{b}', {str(c).lower()})" for k, (a, b, c) in enumerate(model.ALIASES)) + ") AS t(alias_id, src, dst, ext))"
simple(
    "alias_first_match",
    f"""WITH {R}, {_AL}, hit AS (SELECT r.id, min(alias_id) AS alias_id FROM r JOIN al ON starts_with(url, src) GROUP BY 1)
    SELECT r.id, CAST(hit.alias_id AS BIGINT) AS alias_id, coalesce(CASE WHEN ext THEN 'archive://external/' ELSE '' END || dst || substr(url, length(src) + 1), url) AS aliased_url FROM r LEFT JOIN hit USING (id) LEFT JOIN al USING (alias_id)""",
    lambda s, d: resources.first_alias(model.resources(s, d), model.aliases(s)).select("id", "alias_id", "aliased_url"),
)
simple("alias_rewrite", f"WITH x AS ({ORACLE['alias_first_match']}) SELECT id, aliased_url FROM x", lambda s, d: model.resources(s, d).select("id", urls.apply_aliases(F.col("url"), model.ALIASES).alias("aliased_url")))
simple(
    "existing_alternative",
    f"""WITH {R}, have AS (SELECT id, CASE WHEN id % 2 = 0 THEN url ELSE regexp_replace(url, '#.*$', '') END AS url FROM r), a AS (SELECT url, 0 AS pos, url AS alt FROM r UNION ALL SELECT url, 1, regexp_replace(url, '#.*$', '') FROM r WHERE contains(url, '#')),
    h AS (SELECT a.url, arg_min(alt, pos) AS alt, arg_min(have.id, pos) AS hid FROM a JOIN (SELECT url, min(id) AS id FROM have GROUP BY 1) have ON have.url = a.alt GROUP BY 1)
    SELECT r.url, coalesce(h.alt, regexp_replace(r.url, '#.*$', '')) AS resource_url, h.hid AS resource_id FROM r LEFT JOIN h USING (url) GROUP BY ALL""",
    lambda s, d: resources.existing_alternative(urls.with_alternatives(model.resources(s, d).select("url").distinct()), model.resources(s, d).select("id", F.when(F.col("id") % 2 == 0, F.col("url")).otherwise(urls.strip_fragment(F.col("url"))).alias("url")).groupBy("url").agg(F.min("id").alias("id"))),
)
simple(
    "altered_urls",
    f"""WITH {R}, n AS (SELECT id, url, regexp_replace(url, '#.*$', '') AS normal FROM r), w AS (SELECT normal, min(id) AS id FROM n WHERE url <> normal AND normal NOT IN (SELECT url FROM r) GROUP BY 1)
    SELECT n.id, coalesce(w.normal, n.url) AS url FROM n LEFT JOIN w USING (id)""",
    lambda s, d: resources.altered(model.resources(s, d), urls.with_alternatives(model.resources(s, d).select("url").distinct())),
)
simple("url_dimensions", f"WITH {R} SELECT id, CAST(1 + len(regexp_extract_all(regexp_extract(url, '^[a-z]+://[^/]*([^?]*)', 1), '/')) + CASE WHEN contains(url, '?') THEN 1 + len(regexp_extract_all(url, '&')) ELSE 0 END AS INT) AS n_dims, regexp_extract(url, '^[a-z]+:(//[^/]*)', 1) AS host, regexp_extract(url, '([^/?=&]*)$', 1) AS last_value FROM r", lambda s, d: model.resources(s, d).withColumn("dims", urls.dimensions(F.col("url"))).select("id", F.size("dims").alias("n_dims"), F.concat(F.lit("//"), F.element_at("dims", 1)["value"]).alias("host"), F.element_at("dims", -1)["value"].alias("last_value")))
simple("url_dims_roundtrip", f"WITH {R} SELECT id, url FROM r", lambda s, d: model.resources(s, d).select("id", urls.join_dimensions(urls.dimensions(F.col("url"))).alias("url")))
simple("url_is_literal_prefix", f"WITH {G} SELECT CAST(group_id AS BIGINT) AS group_id, regexp_extract(pattern, '^([^*#@]*)', 1) AS prefix FROM g", lambda s, d: groups.group_table(s, model.GROUPS).select("group_id", "prefix"))
simple("probably_embedded", f"WITH {R} SELECT id, id % 2 = 0 AS embedded FROM r", lambda s, d: model.resources(s, d).select("id", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.col("id") % 2 == 0, "/x.JPG?v=1").otherwise("/x.htm")).rlike(links.PROBABLY_EMBEDDED).alias("embedded")))


# Links


def _links(s, d) -> DataFrame:
    return links.explode_links(links.with_links(model.captures(s, d)).select("id", "url", "links"))


simple("links_html", f"WITH {LINKS} SELECT page_id AS id, CAST(pos AS INT) AS pos, relative_url, type_title, title, false AS embedded, target_url FROM tl", lambda s, d: _links(s, d).select("id", "pos", "relative_url", "type_title", "title", "embedded", "target_url"))


@query(ORACLE["links_html"])
def links_of_charsets(s, d):
    """The links of every page, its bytes in one of four charsets that only they themselves tell: by a mark, or by the page's meta tag."""
    html, way = F.col("body"), F.col("id") % 4
    latin = ~html.rlike(r"[^\x00-\xff]")
    marked = lambda charset: F.encode(F.concat(F.lit("\ufeff"), html), charset)
    named = F.encode(F.regexp_replace(html, 'charset="utf-8"', 'charset="iso-8859-1"'), "ISO-8859-1")
    body = F.when(way == 0, F.encode(html, "UTF-8")).when(way == 1, marked("UTF-16LE")).when(way == 2, marked("UTF-16BE")).when(latin, named).otherwise(marked("UTF-8"))
    headers = F.array(F.array(F.lit("Content-Type"), F.lit("text/html")))
    metadata = F.struct(F.lit(200).alias("status_code"), F.lit("OK").alias("reason_phrase"), headers.alias("headers"))
    parsed = links.with_links(model.captures(s, d).withColumn("body", body).withColumn("metadata", metadata))
    return links.explode_links(parsed.select("id", "url", "links")).select("id", "pos", "relative_url", "type_title", "title", "embedded", "target_url")




@query(ORACLE["links_html"])
def links_in_sql(s, d):
    """The links of every page by SQL text alone: a lateral join with a table function."""
    sql.register(s)
    return s.sql("SELECT p.id, l.pos, l.relative_url, l.type_title, l.title, l.embedded, l.target_url FROM {pages} p, LATERAL document_links(p.url, 'html', p.body) l", pages=model.captures(s, d))


@query("SELECT page_id AS id, count(*) AS n_links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">')) FROM pages) GROUP BY 1")
def tags_in_sql(s, d):
    sql.register(s)
    return s.sql("SELECT p.id, count(*) AS n_links FROM {pages} p, LATERAL document_tags(p.body) t WHERE t.tag = 'a' AND t.attributes['href'] IS NOT NULL GROUP BY p.id", pages=model.captures(s, d))


simple("links_per_page", f"WITH {LINKS} SELECT p.page_id AS id, count(pos) AS n_links FROM pages p LEFT JOIN lk USING (page_id) GROUP BY 1", lambda s, d: links.with_links(model.captures(s, d)).select("id", F.size("links").cast("long").alias("n_links")))
simple("link_types", f"WITH {LINKS} SELECT type_title, count(*) AS n FROM lk GROUP BY 1", lambda s, d: _links(s, d).groupBy("type_title").agg(F.count(F.lit(1)).alias("n")))
simple("link_targets_grouped", f"WITH {LINKS} SELECT url, target_url, CAST(min(pos) AS INT) AS first_pos, count(*) AS n_links, false AS any_embedded, string_agg('Link: ' || title, ', ' ORDER BY pos) AS titles FROM tl GROUP BY ALL", lambda s, d: links.by_target(_links(s, d)))
simple("dedup_links", f"WITH {LINKS} SELECT page_id AS id, target_url, CAST(min(pos) AS INT) AS pos FROM tl GROUP BY ALL", lambda s, d: _links(s, d).groupBy("id", "target_url").agg(F.min("pos").alias("pos")))
simple("new_urls_anti", f"WITH {R}, {LINKS} SELECT DISTINCT target_url AS url FROM tl WHERE target_url NOT IN (SELECT url FROM r)", lambda s, d: resources.new_urls(_links(s, d).select(F.col("target_url").alias("url")), model.resources(s, d)))
simple("inserted_urls", f"WITH {R}, {LINKS}, n AS (SELECT DISTINCT target_url FROM tl WHERE target_url NOT IN (SELECT url FROM r)) SELECT (SELECT count(*) FROM r) + (SELECT count(*) FROM n) AS n_rows, (SELECT count(*) FROM r) + (SELECT count(*) FROM n) AS n_ids, (SELECT max(id) FROM r) + (SELECT count(*) FROM n) AS last_id", lambda s, d: resources.insert(model.resources(s, d), _links(s, d).select(F.col("target_url").alias("url"))).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.max("id").alias("last_id")))
simple(
    "link_clusters",
    f"""WITH {R}, {G}, {LINKS}, c AS (SELECT page_id AS id, pos, target_url, unnest(CASE WHEN target_url IN (SELECT url FROM r WHERE id IN (2, 10)) THEN ['root'] WHEN EXISTS (SELECT 1 FROM g WHERE regexp_full_match(target_url, re)) THEN (SELECT list('group ' || group_id) FROM g WHERE regexp_full_match(target_url, re)) ELSE ['other'] END) AS cluster FROM tl)
    SELECT id, CAST(pos AS INT) AS pos, cluster FROM c""",
    lambda s, d: groups.link_clusters(_links(s, d), resources.with_url(model.roots(s), model.resources(s, d)), model.GROUPS).select("id", "pos", "cluster"),
)
simple("links_by_group", f"WITH {G}, {LINKS} SELECT CAST(group_id AS BIGINT) AS group_id, type_title, count(*) AS n_links FROM tl JOIN g ON regexp_full_match(target_url, re) GROUP BY ALL", lambda s, d: groups.membership(_links(s, d).select("type_title", F.col("target_url").alias("url")), model.GROUPS).groupBy("group_id", "type_title").agg(F.count(F.lit(1)).alias("n_links")))
simple("rewrite_links", f"WITH {LINKS} SELECT page_id AS id, relative_url, CASE WHEN starts_with(target_url, 'x') THEN '' ELSE 'http://{HOST}/_/' || regexp_replace(target_url, '^([a-z]+)://', '\\1/') END AS served FROM tl", lambda s, d: _served(s, d))


def _served(s, d):
    parsed = links.with_links(model.captures(s, d)).withColumn("old", F.transform("links", lambda k: k["relative_url"]))
    again = rewrite.responses(parsed, HOST, keep=("id", "old"))
    again = again.withColumn("new", F.transform(links.html_links(F.col("body")), lambda k: k["relative_url"]))
    return again.select("id", F.explode(F.arrays_zip("old", "new")).alias("z")).select("id", F.col("z.old").alias("relative_url"), F.col("z.new").alias("served"))


def _bodies(body: str, content_type: str) -> Query:
    """Links of bodies that an SQL expression makes from every page's id and URL."""
    def run(s, d):
        rows = model.resources(s, d).select("id", F.concat(F.lit("https://site.test/"), F.col("id").cast("string")).alias("url"), F.expr(body).alias("body"))
        headers = F.array(F.array(F.lit("Content-Type"), F.lit(content_type)))
        metadata = F.struct(F.lit(200).alias("status_code"), F.lit("OK").alias("reason_phrase"), headers.alias("headers"))
        return links.explode_links(links.with_links(rows.withColumn("metadata", metadata)).select("id", "url", "links")).select("id", "pos", "relative_url", "type_title", "title", "embedded", "target_url")

    return run


def _linked(*found: tuple[str, str, str, str, str], where: str = "true") -> str:
    """SQL of a body's links: relative URL (an expression), type, title (an expression), embedded and a condition each."""
    rows = " UNION ALL ".join(f"SELECT id, {k} AS k, {u} AS relative_url, '{t}' AS type_title, {title} AS title, {e} AS embedded FROM r WHERE {where} AND {only}" for k, (u, t, title, e, only) in enumerate(found))
    resolved = "CASE WHEN regexp_matches(relative_url, '^[a-z]+://') THEN relative_url WHEN starts_with(relative_url, '//') THEN 'https:' || relative_url WHEN starts_with(relative_url, '/') THEN 'https://site.test' || relative_url ELSE 'https://site.test/' || relative_url END"
    return f"WITH {R}, f AS ({rows}) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INT) AS pos, relative_url, type_title, title, embedded, {resolved} AS target_url FROM f"


_NONE = "CAST(NULL AS VARCHAR)"
simple(
    "links_css",
    _linked(("'i' || id || '.png'", "CSS URL Reference", _NONE, "true", "true"), ("'p' || id || '.css'", "CSS @import", _NONE, "true", "true"), ("'q' || id || '.gif'", "CSS URL Reference", _NONE, "true", "id % 2 = 0")),
    _bodies("""concat('a { background: url(i', id, '.png) } @import "p', id, '.css"; /* url(no.png) */', CASE WHEN id % 2 = 0 THEN concat(' b{c:url("q', id, '.gif");d:"url(s', id, '.png)"} @media x { e{f:url(n', id, '.png)} }') ELSE ' @import url(u.css); g{h:j(url(k.png)), url( "l.png" )}' END)""", "text/css"),
)
simple(
    "links_json",
    _linked(("url", "JSON URL Reference", _NONE, "false", "true"), ("'https://a.test/' || id", "JSON URL Reference", _NONE, "false", "true"), ("'https://b.test/' || id || '/'", "JSON URL Reference", _NONE, "false", "true"), where="id % 5 > 1"),
    _bodies("""CASE id % 5 WHEN 0 THEN '{broken "https://a.test/"' WHEN 1 THEN '"https://a.test/alone"' ELSE concat('{"', url, '": ["https://a.test/', id, '", ', id, ', "no"], "k": {"x": "https:\\\\/\\\\/b.test\\\\/', id, '\\\\/"}}') END""", "application/json"),
)
simple(
    "links_xml",
    _linked(("'https://a.test/rss?i=' || id || '&x'", "Link", _NONE, "false", "id % 3 = 0"), ("'/atom/' || id", "Link", _NONE, "false", "id % 3 = 1")),
    _bodies("""CASE id % 3 WHEN 0 THEN concat('<rss><channel><link> https://a.test/rss?i=', id, '&amp;x </link></channel></rss>') WHEN 1 THEN concat('<feed xmlns="http://www.w3.org/2005/Atom"><link rel="alternate" href="/atom/', id, '"/></feed>') ELSE '<broken' END""", "application/rss+xml"),
)
simple(
    "links_frameset",
    _linked(("'l' || id || '.html'", "Unknown", _NONE, "false", "true"), ("'m.shtm'", "Unknown", _NONE, "false", "true")),
    _bodies("""concat('<html><frameset cols="1"><frame src="l', id, '.html" name="x"><frame src="m.shtm"><a href="n.png"></frameset></html>')""", "text/html"),
)
_RICH = """concat('<style>@import "s', id, '.css";</style><div style="background:url(d', id, '.png)" background="b.gif">', '<img src=i', id, '.png alt="Pic ', id, '" srcset="a', id, '.png 1x, /b.png 2x"><picture title="t"><source alt="no" srcset="w', id, '.webp, /c.webp 2x"></picture>',
    '<link rel=stylesheet href="/l.css"><link rel="icon" href="/f', id, '.ico"><a href="n', id, '?x=1&amp;y=2" title="n', id, '?x=1&amp;y=2">Next <b>page</b></a><iframe src="//o.test/', id, '" name="fr"></iframe>',
    '<b onclick="top.location.href = ''go', id, ''';">go', id, '</b><script integrity="x" src="/k.js"></script><script integrity="y">u("https:\\\\/\\\\/j.test\\\\/', id, '.js", ''no'')</script><p data-u="https://e.test/', id, '">i', id, '.png</p>')"""
_RICH_LINKS = [
    ("'s' || id || '.css'", "CSS @import", _NONE, "true", "true"),
    ("'d' || id || '.png'", "CSS URL Reference", _NONE, "true", "true"),
    ("'b.gif'", "Background Image", _NONE, "true", "true"),
    ("'w' || id || '.webp'", "Image Source", _NONE, "true", "true"),
    ("'/c.webp'", "Image Source", _NONE, "true", "true"),
    ("'i' || id || '.png'", "Image", "'Pic ' || id", "true", "true"),
    ("'//o.test/' || id", "IFrame", "'fr'", "true", "true"),
    ("'/k.js'", "Unknown Embedded (script)", _NONE, "true", "true"),
    ("'a' || id || '.png'", "Image", "'Pic ' || id", "true", "true"),
    ("'/b.png'", "Image", "'Pic ' || id", "true", "true"),
    ("'/l.css'", "Stylesheet", _NONE, "true", "true"),
    ("'/f' || id || '.ico'", "Icon", _NONE, "true", "true"),
    ("'n' || id || '?x=1&y=2'", "Link", "'Next '", "false", "true"),
    ("'go' || id", "Clickable", _NONE, "false", "true"),
    ("'https://j.test/' || id || '.js'", "Script Reference", _NONE, "true", "true"),
    ("'https://e.test/' || id", "Attribute Reference", _NONE, "false", "true"),
]
simple("links_rich_html", _linked(*_RICH_LINKS), _bodies(_RICH, "text/html"))
simple("embedded_links", f"SELECT id, pos, relative_url FROM ({_linked(*_RICH_LINKS)}) WHERE embedded", lambda s, d: _bodies(_RICH, "text/html")(s, d).where("embedded").select("id", "pos", "relative_url"))


@query(
    f"""WITH {R}, p AS (SELECT id, 'http://{HOST}/_/https/site.test/' AS a FROM r)
    SELECT id, '<style>@import "' || a || 's' || id || '.css";</style><div style="background:url(' || a || 'd' || id || '.png)" background="' || a || 'b.gif">'
    || '<img src="' || a || 'i' || id || '.png" alt="Pic ' || id || '" srcset="' || a || 'a' || id || '.png 1x, ' || a || 'b.png 2x"><picture title="t"><source alt="no" srcset="' || a || 'w' || id || '.webp, ' || a || 'c.webp 2x"></picture>'
    || '<link rel=stylesheet href="' || a || 'l.css"><link rel="icon" href="' || a || 'f' || id || '.ico"><a href="' || a || 'n' || id || '?x=1&amp;y=2" title="n' || id || '?x=1&amp;y=2">Next <b>page</b></a>'
    || '<iframe src="http://{HOST}/_/https/o.test/' || id || '" name="fr"></iframe><b onclick="top.location.href = ''' || a || 'go' || id || ''';">go' || id || '</b>'
    || '<script src="' || a || 'k.js"></script><script integrity="y">u("http://{HOST}/_/https/j.test/' || id || '.js", ''no'')</script><p data-u="http://{HOST}/_/https/e.test/' || id || '">i' || id || '.png</p>' AS body FROM p"""
)
def rewrite_rich_html(s, d):
    rows = model.resources(s, d).select("id", F.concat(F.lit("https://site.test/"), F.col("id").cast("string")).alias("url"), F.expr(_RICH).alias("body"))
    metadata = F.struct(F.lit(200).alias("status_code"), F.lit("OK").alias("reason_phrase"), F.array(F.array(F.lit("Content-Type"), F.lit("text/html"))).alias("headers"))
    return rewrite.responses(links.with_links(rows.withColumn("metadata", metadata)), HOST, keep=("id",)).select("id", "body")


simple("favicon_implicit", f"WITH {R} SELECT id, true AS implied FROM r", lambda s, d: model.captures(s, d).withColumn("url", urls.root_slash(urls.domain_prefix(F.col("url")))).transform(links.with_links).select("id", (F.element_at("links", -1)["relative_url"] == "/favicon.ico").alias("implied")))


@query(f"WITH {R} SELECT id, 'https://new.test/' || id AS relative_url, '301 Moved' AS title, true AS embedded FROM r")
def redirect_link(s, d):
    moved = F.struct(F.lit(301).alias("status_code"), F.lit("Moved").alias("reason_phrase"), F.array(F.array(F.lit("location"), F.concat(F.lit("https://new.test/"), F.col("id").cast("string")))).alias("headers"))
    parsed = links.with_links(model.resources(s, d).withColumn("metadata", moved).withColumn("body", F.lit(None).cast("string")))
    return parsed.select("id", F.inline("links")).select("id", "relative_url", "title", "embedded")


# Crawls and inference


def _graph(s, d) -> DataFrame:
    """Links between pages of a ring of hosts: page k links to k + 1 and 2 k."""
    n = model.resources(s, d)
    count = F.lit(n.count())
    to = F.explode(F.array((F.col("id") + 1) % count, (F.col("id") * 2) % count))
    step = n.select("id", "url", to.alias("to"))
    return step.join(n.select(F.col("id").alias("to"), F.col("url").alias("target_url")), "to").select("url", "target_url", (F.col("to") % 2 == 0).alias("embedded"), F.col("to").alias("pos"))


_EDGE = "n AS (SELECT count(*) AS n FROM pages), e AS (SELECT a.url, b.url AS target_url, b.page_id % 2 = 0 AS embedded FROM pages a, n JOIN pages b ON b.page_id = (a.page_id + 1) % n.n OR b.page_id = (a.page_id * 2) % n.n WHERE a.url <> b.url)"
_WALK = "c(url, depth) AS (SELECT url, 0 FROM pages WHERE page_id = 3 UNION SELECT e.target_url, depth + 1 FROM c JOIN e USING (url) WHERE depth < {most})"
simple("frontier_depth3", f"WITH RECURSIVE {_EDGE}, {_WALK.format(most=3)} SELECT url, min(depth) AS depth FROM c GROUP BY 1", lambda s, d: crawl.frontier(model.resources(s, d).where("id = 3").select("url"), _graph(s, d), 3))
simple("crawl_fixpoint", f"WITH RECURSIVE {_EDGE}, w(url) AS (SELECT url FROM pages WHERE page_id = 3 UNION SELECT e.target_url FROM w JOIN e USING (url) WHERE NOT ({_fits('e.target_url', '**?utm_source=feed')})) SELECT url FROM w", lambda s, d: crawl.frontier(model.resources(s, d).where("id = 3").select("url"), _graph(s, d), groups=model.GROUPS).select("url"))
simple(
    "embedding_chains",
    f"""WITH RECURSIVE {_EDGE}, s AS (SELECT DISTINCT url, target_url FROM e WHERE embedded), c(url, path, depth) AS (SELECT url, [url], 1 FROM pages UNION ALL SELECT s.target_url, list_append(path, s.target_url), depth + 1 FROM c JOIN s USING (url) WHERE depth < 3 AND NOT list_contains(path, s.target_url))
    SELECT url, array_to_string(path, ' ') AS path, depth FROM c""",
    lambda s, d: crawl.embedding_chains(model.resources(s, d).select("url"), _graph(s, d).where("url <> target_url")).select("url", F.array_join("path", " ").alias("path"), "depth"),
)
simple("pending_work", f"WITH {R}, {REV} SELECT url, max(id % 3) AS priority FROM r WHERE id NOT IN (SELECT resource_id FROM rev WHERE status_code = 200) GROUP BY 1", lambda s, d: crawl.pending(model.resources(s, d).withColumn("priority", F.col("id") % 3), model.revisions(s, d).where("status_code = 200")))
simple("resume_members", f"WITH {R} SELECT id, url FROM r WHERE {_fits('url', 'https://blog.**')} AND id > 100", lambda s, d: crawl.resume(groups.members(model.resources(s, d), "https://blog.**"), 100))


_STEPS = "WITH t AS (SELECT conv_id, turn + 1 AS k, max(turn + 1) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT 'https://talks.test/c' || conv_id || '/' || k AS url, CAST(CASE WHEN k = 1 THEN 0 ELSE least(k - 1, n - k + 1) END AS INT) AS depth FROM t"


@query(_STEPS)
def crawl_talks(s, d):
    """Everything that the first pages of all talks reach by their parsed links; a first page links to the last one, too."""
    captures, found, *_ = _talks(s, d)
    return crawl.frontier(captures.where("k = 1").select("url"), found)


@query(f"SELECT * FROM ({_STEPS}) WHERE depth <= 2")
def frontier_talks(s, d):
    captures, found, *_ = _talks(s, d)
    return crawl.frontier(captures.where("k = 1").select("url"), found, 2)


@query(f"SELECT url FROM ({_STEPS})")
def standing_crawl(s, d):
    """First turns as a stream of seeds; all that the crawl visits."""
    _, found, *_ = _talks(s, d)
    first = table_stream(s, d, "conversations").where("turn = 0").select(F.concat(F.lit("https://talks.test/c"), F.col("conv_id").cast("string"), F.lit("/1")).alias("url"))
    root = scratch.new_folder(s, "stream")
    crawl.standing(first, found, f"{root}/out", f"{root}/state")
    return crawl.visited(s, f"{root}/out").select("url")


def _page_groups(s, d) -> DataFrame:
    """A group for every page: from the group of half its id, from a root (of odd ids), or from nothing."""
    kind = F.expr("CASE WHEN id % 3 < 2 AND id > 0 THEN 'resource_group' WHEN id % 3 = 2 THEN 'root_resource' END")
    return model.resources(s, d).select(F.col("id").alias("group_id"), F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("g"), F.col("id").cast("string"))).alias("name"), F.concat("url", F.lit("**")).alias("url_pattern"), kind.alias("source_type"), F.when(kind == "resource_group", F.expr("id div 2")).when(kind == "root_resource", F.col("id")).alias("source_id"))


def _page_roots(s, d) -> DataFrame:
    return model.resources(s, d).where("id % 2 = 1").select(F.col("id").alias("root_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"))


_PAGE_GROUPS = "pg AS (SELECT id AS group_id, CASE WHEN id % 2 = 0 THEN '' ELSE 'g' || id END AS name, url || '**' AS url_pattern, CASE WHEN id % 3 < 2 AND id > 0 THEN 'resource_group' WHEN id % 3 = 2 THEN 'root_resource' END AS source_type, CASE WHEN id % 3 < 2 AND id > 0 THEN id // 2 WHEN id % 3 = 2 THEN id END AS source_id FROM r)"
simple(
    "group_sources",
    f"""WITH {R}, {_PAGE_GROUPS}, n AS (SELECT a.group_id, a.source_type, a.source_id, CASE a.source_type WHEN 'resource_group' THEN coalesce(nullif(b.name, ''), b.url_pattern) WHEN 'root_resource' THEN CASE WHEN a.source_id % 2 = 1 THEN 'r' || a.source_id END END AS source_name FROM pg a LEFT JOIN pg b ON b.group_id = a.source_id)
    SELECT group_id, source_type, source_id, source_name, source_type IS NULL OR source_name IS NOT NULL AS source_ok FROM n""",
    lambda s, d: groups.sources(_page_groups(s, d), _page_roots(s, d)),
)
simple(
    "group_source_closure",
    f"""WITH RECURSIVE {R}, {_PAGE_GROUPS}, up AS (SELECT group_id, source_id AS ancestor_id, 1 AS depth FROM pg WHERE source_type = 'resource_group' UNION ALL
    SELECT up.group_id, g.source_id, depth + 1 FROM up JOIN pg g ON g.group_id = up.ancestor_id WHERE g.source_type = 'resource_group')
    SELECT group_id, ancestor_id, depth FROM up""",
    lambda s, d: groups.source_closure(_page_groups(s, d)),
)
simple("whole_site_pattern", f"WITH {R} SELECT id, url || '**' AS pattern FROM r", _of(lambda u: groups.whole_site(u).alias("pattern")))
simple("dims_match", f"WITH {R} SELECT id, url NOT LIKE '%?%' AND url LIKE '%/en/%' AND url NOT LIKE '%/' AND url LIKE 'https:%' AS same FROM r", lambda s, d: model.resources(s, d).withColumn("dims", urls.dimensions(F.col("url"))).select("id", (urls.same_structure(F.col("dims"), urls.dimensions(F.lit("https://x.test/en/7"))) & (F.get("dims", F.lit(1))["value"] == "en")).alias("same")))


def _talks(s, d) -> tuple[DataFrame, DataFrame, DataFrame, list[groups.Group], DataFrame]:
    """Conversations as a site of numbered pages: captures, their parsed links, roots, groups and requests.

    Each turn is a page that links to the ones before and after it, the first
    also to the last; a page for each conversation, a root, links to all its
    turns.  Every page is requested from that root and from the page before it.
    """
    turns = model.table(s, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("k"), "text")
    lengths = turns.groupBy("conv_id").agg(F.max("k").alias("n"))
    place = F.concat(F.lit("https://talks.test/c"), F.col("conv_id").cast("string"), F.lit("/"))

    def anchor(k: Column) -> Column:
        return F.concat(F.lit('<a href="'), k.cast("string"), F.lit('">'), k.cast("string"), F.lit("</a>"))

    near = F.array_compact(F.array(F.when(F.col("k") > 1, F.col("k") - 1), F.when(F.col("k") < F.col("n"), F.col("k") + 1), F.when(F.col("k") == 1, F.col("n"))))
    pages = turns.join(lengths, "conv_id").withColumn("near", near)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " ")
    pages = pages.select((F.col("conv_id") * 100 + F.col("k")).alias("id"), "conv_id", "k", F.concat(place, F.col("k").cast("string")).alias("url"), F.concat(F.lit("<p>"), text, F.lit("</p>"), F.array_join(F.transform("near", anchor), " ")).alias("body"))
    index = lengths.select((F.col("conv_id") * 100).alias("id"), "conv_id", F.lit(0).cast("long").alias("k"), place.alias("url"), F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), "n"), anchor), " ").alias("body"))
    headers = F.array(F.array(F.lit("Content-Type"), F.lit("text/html")))
    captures = pages.union(index).withColumn("metadata", F.struct(F.lit(200).alias("status_code"), F.lit("OK").alias("reason_phrase"), headers.alias("headers"))).withColumn("status_code", F.lit(200))
    found = scratch.written(links.explode_links(links.with_links(captures).select("url", "links")).select("url", "target_url"), "talk-links")
    roots = index.select(F.col("conv_id").alias("root_id"), "url")
    own = [groups.Group(8, "All talks", "https://talks.test/**")]
    from_root = pages.select((F.col("id") * 10).alias("request_id"), "url", place.alias("referrer_url"))
    from_page = pages.where("k > 1").select((F.col("id") * 10 + 1).alias("request_id"), "url", F.concat(place, (F.col("k") - 1).cast("string")).alias("referrer_url"))
    from_nowhere = index.select((F.col("id") * 10).alias("request_id"), "url", F.lit(None).cast("string").alias("referrer_url"))
    return captures, found, roots, own, from_root.union(from_page).union(from_nowhere)


_TALKS = """t AS (SELECT conv_id, turn + 1 AS k, max(turn + 1) OVER (PARTITION BY conv_id) AS n, 'https://talks.test/c' || conv_id || '/' AS place FROM conversations),
    q AS (SELECT (conv_id * 100 + k) * 10 AS request_id, *, true AS from_root FROM t UNION ALL SELECT (conv_id * 100 + k) * 10 + 1, *, false FROM t WHERE k > 1),
    f AS (SELECT min(conv_id) AS first_id, min_by(n, conv_id) AS first_n FROM t)"""


@query(
    f"""WITH {_TALKS} SELECT request_id, CASE WHEN from_root THEN 'root_resource' ELSE 'resource_group' END AS source_type, CASE WHEN from_root THEN conv_id ELSE 8 END AS source_id,
        CASE WHEN from_root OR conv_id = first_id THEN CASE WHEN n >= 3 THEN place || '#' END ELSE 'https://talks.test/*/#' END AS url_pattern FROM q, f
    UNION ALL SELECT DISTINCT conv_id * 1000, NULL, NULL, NULL FROM t"""
)
def detect_regular_group(s, d):
    """Requests from a root have its own links as candidates, others those of the first three pages of the site's group."""
    captures, edges, roots, own, requests = _talks(s, d)
    return inference.detect_regular(requests, roots, own, captures.select("id", "url"), edges).select("request_id", "source_type", "source_id", "url_pattern")


@query(
    f"""WITH {_TALKS} SELECT request_id, place || '#' AS url_pattern, 2 AS dimension, 1::BIGINT AS first_page, CASE WHEN k = 2 AND n > 3 THEN NULL ELSE n END AS last_page FROM q WHERE n > 1"""
)
def detect_sequential_group(s, d):
    """The first page links to the last; on the second page that link is not seen, so its last page is known only if it is next."""
    captures, edges, roots, own, requests = _talks(s, d)
    return inference.detect_sequential(requests, roots, own, captures, edges).select("request_id", "url_pattern", "dimension", "first_page", "last_page")


@query(f"WITH {_TALKS} SELECT request_id, CASE WHEN n > 1 THEN place || '#' ELSE place || k END AS url_pattern FROM q UNION ALL SELECT DISTINCT conv_id * 1000, place FROM t")
def best_prediction(s, d):
    captures, edges, roots, own, requests = _talks(s, d)
    regular = inference.detect_regular(requests, roots, own, captures.select("id", "url"), edges)
    return inference.best_prediction(inference.detect_sequential(requests, roots, own, captures, edges), regular).select("request_id", "url_pattern")


@query(
    f"""WITH {LINKS}, q AS (SELECT page_id * 1000 + min(pos) AS request_id, page_id AS source_id, url AS page, target_url AS url FROM tl GROUP BY page_id, url, target_url),
    n AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM q)
    SELECT request_id, url, 'root_resource' AS source_type, source_id, CASE WHEN n >= 3 THEN regexp_extract(page, '^([a-z]+://[^/?#]*)', 1) || '/*' END AS url_pattern FROM n"""
)
def detect_regular_pages(s, d):
    """Every link of every page as a request from that page, which is a root."""
    found = _links(s, d).groupBy("id", "url", "target_url").agg(F.min("pos").alias("pos"))
    requests = found.select((F.col("id") * 1000 + F.col("pos")).alias("request_id"), F.col("target_url").alias("url"), F.col("url").alias("referrer_url"), F.col("id").alias("referrer_id"))
    roots = model.resources(s, d).select(F.col("id").alias("root_id"), F.col("id").alias("resource_id"), "url")
    return inference.detect_regular(requests, roots, model.GROUPS, model.resources(s, d), found.select(F.col("id").alias("resource_id"), "url", "target_url")).drop("referrer_url")


# Bodies, samples, streams


simple("revision_path", f"WITH {REV}, h AS (SELECT id, printf('%015x', id) AS h FROM rev) SELECT id, 'revisions/' || h[1:3] || '/' || h[4:6] || '/' || h[7:9] || '/' || h[10:12] || '/' || h[13:15] AS path, 'revisions/' || id AS flat FROM h", lambda s, d: model.revisions(s, d).select("id", bodies.hierarchical_path(F.col("id")).alias("path"), bodies.flat_path(F.col("id")).alias("flat")))
simple("pack_path", f"WITH {REV}, h AS (SELECT id, printf('%015x', id) AS h FROM rev) SELECT id, 'revisions/' || h[1:3] || '/' || h[4:6] || '/' || h[7:9] || '/' || h[10:12] || '/' || h[13:14] || '_.zip' AS path, h[13:15] AS entry FROM h", lambda s, d: model.revisions(s, d).select("id", bodies.pack_path(F.col("id")).alias("path"), bodies.entry_name(F.col("id")).alias("entry")))
simple("pack_groups", f"WITH {REV} SELECT id // 16 AS pack_id, count(*) AS n_revisions, bool_or(id % 16 = 15) AS complete FROM rev GROUP BY 1", lambda s, d: bodies.packs(model.revisions(s, d)))
simple("body_sizes", "SELECT page_id AS id, CAST(octet_length(encode(html)) AS INT) AS size FROM pages", lambda s, d: model.captures(s, d).select("id", F.octet_length("body").alias("size")))
simple(
    "sample_ids",
    f"""WITH {R}, b AS (SELECT min(id) AS lo, max(id) - min(id) + 1 AS span FROM r),
    t AS (SELECT turn, ('0x' || substr(md5('7:' || turn), 1, 15))::BIGINT % span + lo AS id FROM b, unnest(range(0, 100000)) AS u(turn))
    SELECT id FROM t WHERE id IN (SELECT id FROM r) ORDER BY turn LIMIT 50""",
    lambda s, d: resources.sample_ids(model.resources(s, d), 50, 7),
)
simple("progress_percent", f"WITH {R}, {REV}, g AS (SELECT count(*) AS total, count(*) FILTER (WHERE id IN (SELECT resource_id FROM rev)) AS done FROM r) SELECT done, total, CASE WHEN total = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * done / total END AS percent FROM g", lambda s, d: _progress(s, d))
simple(
    "format_interval",
    f"""WITH {REV}, t AS (SELECT id, id * 37 AS s FROM rev), p AS (SELECT id, s // 86400 AS d, s % 86400 // 3600 AS h, s % 3600 // 60 AS m, s % 60 AS c FROM t)
    SELECT id, CASE WHEN d > 0 THEN d || 'd + ' || h || ':' || printf('%02d:%02d', m, c) WHEN h > 0 THEN h || ':' || printf('%02d:%02d', m, c) ELSE printf('%02d:%02d', m, c) END AS shown FROM p""",
    lambda s, d: model.revisions(s, d).select("id", resources.format_interval(F.col("id") * 37).alias("shown")),
)
simple(
    "format_size",
    f"""WITH {REV}, b AS (SELECT id, id * id * id AS n FROM rev),
    u AS (SELECT *, CASE WHEN n >= 1024::BIGINT ** 4 THEN 4 WHEN n >= 1024::BIGINT ** 3 THEN 3 WHEN n >= 1024 ** 2 THEN 2 ELSE 1 END AS u FROM b),
    h AS (SELECT *, CAST(floor(n::DOUBLE * 100 / pow(1024, u) + 0.5) AS BIGINT) AS h FROM u)
    SELECT id, CASE WHEN n = 1 THEN '1 byte' WHEN n < 1024 THEN n || ' bytes' ELSE regexp_replace((h // 100) || '.' || printf('%02d', h % 100), '\\.?0+$', '') || ' ' || ['KB', 'MB', 'GB', 'TB', 'PB'][u] END AS shown FROM h""",
    lambda s, d: model.revisions(s, d).select("id", (F.col("id").cast("decimal(38,0)") * F.col("id") * F.col("id")).alias("n")).select("id", resources.format_size(F.col("n")).alias("shown")),
)


def _progress(s, d):
    done = revisions.with_any(model.resources(s, d), model.revisions(s, d)).agg(F.count(F.lit(1)).alias("done"))
    total = model.resources(s, d).agg(F.count(F.lit(1)).alias("total"))
    both = done.crossJoin(total)  # two single rows
    return both.select("done", "total", resources.progress(F.col("done"), F.col("total")).alias("percent"))


@query(ORACLE["group_membership"])
def stream_group_membership(s, d):
    schema = "page_id long, url string, html string"
    stream = table_stream(s, d, "pages", schema).select(F.col("page_id").alias("id"), "url")
    found = streaming.standing_membership(stream, model.GROUPS)
    root = scratch.new_folder(s, "stream")
    streaming.run_available(found, f"{root}/out", f"{root}/state")
    return s.read.schema(found.schema).parquet(f"{root}/out")


_LAST = "l AS (SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1), m AS (SELECT l.id, url FROM l JOIN pages ON page_id = seq % (SELECT max(page_id) + 1 FROM pages) WHERE kind <> 'error')"


@query(f"WITH {G}, {_LAST} SELECT id, url, CAST(group_id AS BIGINT) AS group_id FROM m JOIN g ON regexp_full_match(url, re)")
def stream_member_changes(s, d):
    """Events as a stream of changes (each moves its user to a page, an error deletes the user); what the emitted additions and removals leave."""
    n = model.table(s, d, "pages").agg(F.max("page_id") + 1).first()[0]
    events = table_stream(s, d, "events")
    pages = model.table(s, d, "pages").select("page_id", "url")
    moved = events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), (F.col("event_type") == "error").alias("deleted"), (F.col("event_id") % n).alias("page_id")).join(pages, "page_id")
    root = scratch.new_folder(s, "stream")
    streaming.run_available(changes.member_changes(moved, model.GROUPS), f"{root}/out", f"{root}/state")
    return changes.members_of(s.read.schema(changes.CHANGES).parquet(f"{root}/out"))


def table_stream(s, d, name: str, schema=None) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files: the path is a pattern that only the table fits."""
    return streaming.resource_stream(s, f"{d}/{{{name}}}.parquet", schema or s.read.parquet(f"{d}/{name}.parquet").schema)


@query("SELECT page_id AS id, octet_length(encode(html)) AS size, sha256(html) AS digest FROM pages WHERE html IS NOT NULL")
def packed_bodies(s, d):
    """Every page's body written to packs in the shared folder, and read back from there."""
    folder = scratch.new_folder(s, "packs")
    body = model.captures(s, d).select("id", F.encode("body", "UTF-8").alias("body"))
    bodies.write_packs(body, folder).write.format("noop").mode("overwrite").save()
    return bodies.read_bodies(s, folder).select("id", "size", F.sha2("body", 256).alias("digest"))


@query("SELECT '000/000/000/' || printf('%03x', page_id // 4096) || '/' || printf('%02x', page_id // 16 % 256) || '_.zip' AS path, count(*) AS n FROM pages WHERE page_id // 16 >= (SELECT max(page_id) // 32 FROM pages) AND html IS NOT NULL GROUP BY ALL")
def resumed_packs(s, d):
    """The packs that a second run writes, after one of the first half and of one page more."""
    folder = scratch.new_folder(s, "packs")
    body = model.captures(s, d).select("id", F.encode("body", "UTF-8").alias("body"))
    half = body.agg(F.expr("max(id) div 32 * 16").alias("h")).first()["h"] or 0
    bodies.write_packs(body.where(F.col("id") <= half), folder).write.format("noop").mode("overwrite").save()
    return bodies.write_missing_packs(s, body, folder)


@query(f"WITH {R}, {REV} SELECT rev.id, resource_id, url FROM rev JOIN r ON r.id = resource_id")
def laid_out_join(s, d):
    """Revisions with their URLs from tables bucketed by resource: bucket joins bucket."""
    folder = scratch.new_folder(s, "layout")
    tables = {"resource": model.resources(s, d), "resource_revision": model.revisions(s, d).select("id", "resource_id", "request_cookie", "error")}
    held = layout.lay_out(tables, folder, 8, f"laid_{folder[-12:]}_")
    return layout.resources_with_revisions(held["resource"], held["resource_revision"]).select("id", "resource_id", "url")


simple(
    "task_rates",
    """WITH p AS (SELECT 'u' || user_id AS task_id, event_id / 100::DOUBLE AS seconds, event_id // 3 AS done, 100000 + event_id // 10 AS total FROM events),
    g AS (SELECT *, seconds - lag(seconds) OVER w AS step, done - lag(done) OVER w - (total - lag(total) OVER w) AS gain, pow(2::DOUBLE, (seconds - min(seconds) OVER (PARTITION BY task_id)) / 60) AS weight FROM p WINDOW w AS (PARTITION BY task_id ORDER BY seconds)),
    t AS (SELECT *, sum(gain * weight) OVER v / sum(step * weight) OVER v AS rate FROM g WINDOW v AS (PARTITION BY task_id ORDER BY seconds ROWS UNBOUNDED PRECEDING))
    SELECT task_id, seconds, round(rate, 6) AS rate, rate > 0 AS gaining FROM t""",
    lambda s, d: resources.rates(model.table(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("task_id"), (F.col("event_id") / 100.0).alias("seconds"), F.expr("event_id div 3").alias("done"), F.expr("100000 + event_id div 10").alias("total")))
    .select("task_id", "seconds", F.round("rate", 6).alias("rate"), (F.col("rate") > 0).alias("gaining")),
)
_FOOT = '<div id="kept">kept</div>'
simple(
    "page_insertions",
    f"""SELECT page_id AS id, sha256(CASE WHEN regexp_matches(h, '(?i)</body\\s*>') THEN regexp_replace(h, '(?is)^(.*)(</body\\s*>)', '\\1{_FOOT}\\2') WHEN regexp_matches(h, '(?i)</html\\s*>') THEN regexp_replace(h, '(?is)^(.*)(</html\\s*>)', '\\1{_FOOT}\\2') ELSE h END) AS digest
    FROM (SELECT page_id, CASE WHEN contains(html, '<head>') THEN regexp_replace(html, '<head>', '<head><meta name="robots" content="none"><link rel="icon" href="/i' || page_id || '.ico">') ELSE html END AS h FROM pages)""",
    lambda s, d: model.captures(s, d).select("id", F.sha2(rewrite.add_footer(rewrite.add_robots(rewrite.add_favicon(F.col("body"), F.concat(F.lit("/i"), F.col("id").cast("string"), F.lit(".ico")))), F.lit(_FOOT), "kept"), 256).alias("digest")),
)


@query(f"WITH {R}, {REV}, gone AS (SELECT id FROM r WHERE {_fits('url', 'https://blog.**')}) SELECT 'resource' AS kind, id FROM r WHERE id NOT IN (FROM gone) UNION ALL SELECT 'revision', id FROM rev WHERE resource_id NOT IN (FROM gone) UNION ALL SELECT 'body', id FROM rev WHERE error = 'null' AND resource_id NOT IN (FROM gone)")
def without_deleted(s, d):
    """What is left of resources, revisions and bodies when a group's resources are deleted."""
    rev = model.revisions(s, d)
    held = rev.where(~http.has_error(F.col("error"))).select("id")
    left = revisions.deleted(rev, held, model.resources(s, d), groups.members(model.resources(s, d), "https://blog.**"))
    named = [t.select(F.lit(kind).alias("kind"), "id") for kind, t in zip(("resource", "revision", "body"), left, strict=True)]
    return named[0].union(named[1]).union(named[2])


@query("SELECT DISTINCT event_type || ' ' || user_id AS url FROM events")
def stream_first_seen(s, d):
    """Each kind of event of each user once, as a stream first meets it."""
    events = table_stream(s, d, "events").select(F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("url"))
    root = scratch.new_folder(s, "stream")
    streaming.run_available(streaming.first_seen(events), f"{root}/out", f"{root}/state")
    return s.read.schema("url string").parquet(f"{root}/out")


simple(
    "missing_packs",
    f"WITH {REV} SELECT id // 16 AS pack_id, count(*) AS n_loose FROM rev WHERE status_code = 200 AND (id // 16 * 16 + 15) IN (SELECT id FROM rev) AND id // 16 NOT IN (SELECT id // 16 FROM rev WHERE status_code = 301) GROUP BY 1",
    lambda s, d: bodies.missing_packs(model.revisions(s, d), model.revisions(s, d).where("status_code = 200"), model.revisions(s, d).where("status_code = 301")),
)


@query("SELECT page_id AS id, octet_length(encode(html)) AS size, sha256(html) AS digest FROM pages WHERE html IS NOT NULL AND page_id >= (SELECT max(page_id) // 2 FROM pages)")
def pack_range_read(s, d):
    """The later half of the bodies: the range of ids reaches the reader, which opens no pack below it."""
    folder = scratch.new_folder(s, "packs")
    body = model.captures(s, d).select("id", F.encode("body", "UTF-8").alias("body"))
    bodies.write_packs(body, folder).write.format("noop").mode("overwrite").save()
    half = body.agg(F.expr("max(id) div 2").alias("h")).first()["h"] or 0
    return bodies.read_packs(s, folder).where(F.col("id") >= half).select("id", F.col("size").cast("int").alias("size"), F.sha2("body", 256).alias("digest"))


@query(
    f"""WITH {REV}, {HEAD} SELECT resource_id, error <> 'null' AS failed, CASE WHEN error = 'null' THEN status_code END AS status_code, CASE WHEN error = 'null' THEN strftime(date, '%a, %d %b %Y %H:%M:%S GMT') END AS date,
    CASE WHEN error = 'null' THEN octet_length(encode('body ' || id)) END AS size, (SELECT count(*) FROM rev) AS n_ids, (SELECT count(*) FROM rev) AS last_id FROM head"""
)
def record_revisions(s, d):
    """Events as responses and failures, recorded in the shared folder and read back with their bodies."""
    rev = model.revisions(s, d)
    error = F.when(http.has_error(F.col("error")), F.struct(F.lit("IOError").alias("type"), F.lit("lost").alias("message")))
    headers = F.filter("headers", lambda h: F.lower(h[0]) != "date")
    fetched = rev.select("resource_id", "request_cookie", F.lit(11).alias("http_version"), "status_code", F.lit("OK").alias("reason_phrase"), headers.alias("headers"), F.encode(F.concat(F.lit("body "), F.col("id").cast("string")), "UTF-8").alias("body"), error.alias("error"), F.col("date").cast("timestamp").alias("fetched_at"))
    folder = scratch.new_folder(s, "project")
    project.record_revisions(s, fetched, folder)
    rows = project.open_project(s, folder)["resource_revision"]
    held = recorded.read_recorded_bodies(s, f"{folder}/{project.RECORDED}").select("id", "size")
    ids = rows.agg(F.countDistinct("id").alias("n_ids"), F.max("id").alias("last_id"))
    made = rows.join(held, "id", "left").withColumn("m", http.decode_metadata(F.col("metadata"))).crossJoin(F.broadcast(ids))  # one row
    return made.select("resource_id", http.has_error(F.col("error")).alias("failed"), F.col("m.status_code").alias("status_code"), http.first_header(F.col("m.headers"), "date").alias("date"), "size", "n_ids", "last_id")

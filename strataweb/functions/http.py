"""Columns over response metadata: status, headers, dates, freshness.

``headers`` is ``array<array<string>>`` of name and value, in order, with
duplicates.  Nothing reads a clock: times are parameters.
"""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import cookie_applies

METADATA_DDL = "http_version int, status_code int, reason_phrase string, headers array<array<string>>"
ERROR_DDL = "type string, message string"

XML_TYPES = ["text/xml", "application/xml", "application/rss+xml", "application/atom+xml"]
# Content types whose bodies hold no links: fixed values.
BINARY_TYPES = [
    "application/gzip", "application/java-archive", "application/zip", "application/vnd.rar", "application/x-tar", "application/x-7z-compressed",
    "audio/aac", "audio/mp4", "audio/mpeg", "audio/ogg", "audio/opus", "audio/vorbis", "audio/midi", "audio/x-midi", "audio/wav", "audio/webm",
    "font/otf", "font/ttf", "font/woff", "font/woff2", "application/vnd.ms-fontobject",
    "image/apng", "image/bmp", "image/gif", "image/jpeg", "image/png", "image/tiff", "image/webp", "image/vnd.microsoft.icon",
    "video/mp4", "video/ogg", "video/quicktime", "video/x-msvideo", "video/mpeg", "video/webm",
]
# Headers that may be played back as they are: fixed values.
ALLOWED_HEADERS = [
    "date", "vary", "content-disposition", "content-language", "content-type", "server", "last-modified", "etag", "content-encoding",
    "x-xss-protection", "x-content-type-options", "x-frame-options", "x-download-options", "x-permitted-cross-domain-policies",
    "access-control-allow-origin", "access-control-allow-methods", "access-control-expose-headers",
    "cross-origin-resource-policy", "cross-origin-opener-policy", "timing-allow-origin", "server-timing",
    "x-amz-cf-id", "x-amz-cf-pop", "x-amz-storage-class", "x-amz-id-2", "x-amz-request-id", "x-amz-version-id",
    "cf-cache-status", "cf-ray", "cf-request-id", "cf-bgj", "cf-polished",
    "x-goog-generation", "x-goog-hash", "x-goog-metageneration", "x-goog-storage-class", "x-goog-stored-content-encoding", "x-goog-stored-content-length", "x-guploader-uploadid",
    "detected-user-agent", "fastly-restarts", "normalized-user-agent", "request_came_from_shield", "surrogate-control", "x-served-by",
    "x-envoy-attempt-count", "x-envoy-upstream-service-time", "x-imgix-id", "x-cluster",
]
# Headers known to cause problems when played back, or ignored: fixed values.
DENIED_HEADERS = [
    "transfer-encoding", "content-length", "accept-ranges", "connection", "keep-alive", "via",
    "cache-control", "age", "expires", "pragma", "set-cookie", "p3p", "expect-ct", "strict-transport-security", "link",
    "content-security-policy-report-only", "cross-origin-embedder-policy-report-only", "cross-origin-opener-policy-report-only", "nel", "report-to",
    "referrer-policy", "upgrade", "alt-svc", "x-ratelimit-limit", "x-ratelimit-remaining", "x-ratelimit-count", "x-ratelimit-reset",
    "x-powered-by", "x-monk", "x-cache", "x-ecn-p", "vtag",
]
#: Headers that a 304 response overlays on the revision it confirms: fixed values.
OVERLAID_HEADERS = ["Cache-Control", "Content-Location", "Date", "ETag", "Expires", "Vary"]


# JSON columns: "no value" is the JSON text null.


def decode_metadata(text: Column) -> Column:
    return F.when(text != "null", F.from_json(text, METADATA_DDL))


def decode_error(text: Column) -> Column:
    return F.when(text != "null", F.from_json(text, ERROR_DDL))


def encode(value: Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("null"))


# Status


def is_redirect(status: Column) -> Column:
    return F.coalesce(F.floor(status / 100) == 3, F.lit(False))


def is_not_modified(status: Column) -> Column:
    return F.coalesce(status == 304, F.lit(False))


def is_error_page(status: Column) -> Column:
    """4xx or 5xx; an unknown status counts as 500."""
    return F.floor(F.coalesce(status, F.lit(500)) / 100).isin(4, 5)


def has_error(error: Column) -> Column:
    return F.coalesce(error != "null", F.lit(False))


# Headers


def first_header(headers: Column, name: str) -> Column:
    """The value of the first header of that name, whatever its case; null if none."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h[0]) == name.lower()), F.lit(1))[1]


def declared_content_type(headers: Column) -> Column:
    """The media type of Content-Type, lower-cased; ``text/plain`` if malformed, null if absent."""
    value = first_header(headers, "content-type")
    kind = F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1))))
    return F.when(value.isNotNull(), F.when(kind.rlike(r"^[^/\s]+/[^/\s]+$"), kind).otherwise("text/plain"))


def declared_charset(headers: Column) -> Column:
    value = F.regexp_extract(first_header(headers, "content-type"), r"""(?i);\s*charset\s*=\s*(?:"([^"]*)"|([^;\s]+))""", 0)
    bare = F.regexp_replace(F.regexp_replace(value, r"(?i)^;\s*charset\s*=\s*", ""), '"', "")
    return F.nullif(bare, F.lit(""))


#: Bytes of a body that are looked at for its charset.
PRESCAN = 1024


def detected_charset(body: Column) -> Column:
    """The charset that a binary body itself names, lower-cased; null if none.

    Its byte-order mark, else what its first kilobyte says: a ``<meta>`` tag
    outside comments, an XML declaration or a CSS ``@charset``.  A text that
    such ASCII names as UTF-16 is no UTF-16, and counts as UTF-8.
    """
    mark = F.hex(F.substring(body, 1, 3))
    bom = F.when(mark == "EFBBBF", "utf-8").when(mark.startswith("FEFF"), "utf-16be").when(mark.startswith("FFFE"), "utf-16le")
    head = F.decode(F.substring(body, 1, PRESCAN), "ISO-8859-1")
    seen = F.regexp_replace(head, r"(?s)<!--.*?(?:-->|$)", "")
    rules = [(seen, r"""(?is)<meta\s[^>]*?charset\s*=\s*["']?\s*([a-z0-9_.:\-]+)"""), (head, r"""(?i)^\s*<\?xml[^>]*?encoding\s*=\s*["']([a-z0-9_.:\-]+)["']"""), (head, r"""(?i)^@charset "([a-z0-9_.:\-]+)";""")]
    named = F.lower(F.coalesce(*(F.nullif(F.regexp_extract(text, rule, 1), F.lit("")) for text, rule in rules)))
    return F.coalesce(bom, F.when(named.startswith("utf-16"), "utf-8").otherwise(named))


def guessed_type(url: Column) -> Column:
    """By the extension of the URL's path, from the standard table of media types."""
    extension = F.lower(F.regexp_extract(url, r"^[^?#]*/[^/?#]*(\.[A-Za-z0-9]+)(?:[?#].*)?$", 1))
    table = F.create_map(*(F.lit(x) for kv in sorted(mimetypes.types_map.items()) for x in kv))
    return F.when(extension != "", F.try_element_at(table, extension))


def content_type(headers: Column, url: Column) -> Column:
    return F.coalesce(declared_content_type(headers), guessed_type(url))


def document_kind(kind: Column) -> Column:
    """html, css, json or xml; null for other types."""
    return F.when(kind == "text/html", "html").when(kind == "text/css", "css").when(kind == "application/json", "json").when(kind.isin(XML_TYPES), "xml")


def is_binary(kind: Column) -> Column:
    return kind.isin(BINARY_TYPES)


def redirect_url(status: Column, headers: Column) -> Column:
    return F.when(is_redirect(status), first_header(headers, "location"))


def redirect_title(status: Column, reason: Column) -> Column:
    return F.when(is_redirect(status), F.concat_ws(" ", status.cast("string"), reason))


def http_date(text: Column) -> Column:
    """A date such as ``Wed, 16 Aug 2023 00:00:00 GMT``; null if malformed."""
    shape = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), [0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} GMT$"
    return F.when(text.rlike(shape), F.try_to_timestamp(F.substr(text, F.lit(6), F.lit(20)), F.lit("dd MMM yyyy HH:mm:ss")))


def format_http_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def age_seconds(headers: Column) -> Column:
    """The Age header, if it is a whole number of seconds not below 0."""
    value = F.trim(first_header(headers, "age"))
    return F.when(value.rlike(r"^\+?[0-9]+$"), value.try_cast("long"))


def date_plus_age(headers: Column) -> Column:
    date = http_date(first_header(headers, "date"))
    return F.when(date.isNotNull(), date + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(age_seconds(headers), F.lit(0))))


def with_date(headers: Column, now: Column) -> Column:
    """The headers with ``Date: now`` appended if they have no Date."""
    return F.when(first_header(headers, "date").isNull(), F.concat(headers, F.array(F.array(F.lit("Date"), format_http_date(now))))).otherwise(headers)


def replace_header(headers: Column, name: str, value: Column) -> Column:
    """The first header of that name set to ``value``; appended if there is none."""
    at = F.array_position(F.transform(headers, lambda h: F.lower(h[0])), name.lower())
    changed = F.transform(headers, lambda h, i: F.when(i + 1 == at, F.array(h[0], value)).otherwise(h))
    return F.when(at > 0, changed).otherwise(F.concat(headers, F.array(F.array(F.lit(name), value))))


def playable(headers: Column) -> Column:
    """The headers that may be played back; unknown ones go, as denied ones do."""
    return F.filter(headers, lambda h: F.lower(h[0]).isin(ALLOWED_HEADERS))


def overlay(headers: Column, newer: Column) -> Column:
    """``headers`` with those of a 304 response in place of theirs."""
    for name in OVERLAID_HEADERS:
        value = first_header(newer, name)
        headers = F.when(value.isNotNull(), F.concat(_without(headers, name), F.array(F.array(F.lit(name), value)))).otherwise(headers)
    return headers


def _without(headers: Column, name: str) -> Column:
    return F.filter(headers, lambda h: F.lower(h[0]) != name.lower())


def cache_control(request_path: Column) -> Column:
    at_root = ~F.contains(F.substr(request_path, F.lit(2)), F.lit("/"))
    return F.when(at_root, "max-age=0, must-revalidate").otherwise("max-age=3600")


# Freshness


def is_stale(url: Column, request_cookie: Column, fetched: Column, project_cookie: str | None = None, default_prefix: str | None = None, min_fetch_date: Column | None = None) -> Column:
    """Whether the cookie that applies to the URL differs, or it was fetched by ``min_fetch_date``; an unknown date is fresh."""
    stale = F.lit(False)
    if project_cookie is not None:
        stale = cookie_applies(url, default_prefix) & ~request_cookie.eqNullSafe(F.lit(project_cookie))
    if min_fetch_date is not None:
        stale = stale | F.coalesce(fetched <= min_fetch_date, F.lit(False))
    return stale

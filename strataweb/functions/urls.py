"""URL functions.

What has a regular shape is column expressions; Python's own resolution and
quoting rules come from :mod:`urllib` in Arrow-batched UDFs, which get only the
rows that need them (null in, null out).
"""

from __future__ import annotations

import json
import re
import string
from base64 import urlsafe_b64decode, urlsafe_b64encode
from collections.abc import Callable
from urllib.parse import parse_qs, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: RFC 3986, appendix B, as groups: scheme, authority, path, query, fragment.
_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: What marks a URL outside the archive, unless the stored data use another prefix.
EXTERNAL_PREFIX = "archive://external/"
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def _lift(function: Callable) -> Callable[..., Column]:
    """A row function of texts as a pandas UDF; rows with a null argument are null."""

    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else function(*row) for row in zip(*columns, strict=True)], dtype=object)

    arity = function.__code__.co_argcount
    if arity == 1:
        return F.pandas_udf(lambda a: batch(a), T.StringType())
    return F.pandas_udf(lambda a, b: batch(a, b), T.StringType())


# Parts


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def scheme(url: Column) -> Column:
    """Lower-cased; empty if there is none."""
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def fragment(url: Column) -> Column:
    return part(url, 5)


def compose(scheme_: Column, netloc_: Column, path_: Column, query_: Column, fragment_: Column) -> Column:
    """A URL of its parts; empty query and fragment leave no mark."""
    return F.concat(
        F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""),
        F.when(netloc_ != "", F.concat(F.lit("//"), netloc_, F.when((path_ != "") & ~path_.startswith("/"), "/").otherwise(""))).otherwise(F.when(path_.startswith("//"), "//").otherwise("")),
        path_,
        F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""),
        F.when(fragment_ != "", F.concat(F.lit("#"), fragment_)).otherwise(""),
    )


def is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def is_unrewritable(url: Column) -> Column:
    return url.rlike("^(mailto|javascript|data):")


# Normal form, step by step


def reserialised(url: Column) -> Column:
    """Scheme lower-cased, empty query and fragment marks dropped."""
    return compose(scheme(url), netloc(url), path(url), query(url), fragment(url))


def strip_fragment(url: Column) -> Column:
    return compose(scheme(url), netloc(url), path(url), query(url), F.lit(""))


def lower_host(url: Column) -> Column:
    """For http and https URLs of an ASCII host."""
    plain = is_http(url) & ~netloc(url).rlike(r"[^\x00-\x7F]")
    return F.when(plain, compose(scheme(url), F.lower(netloc(url)), path(url), query(url), fragment(url))).otherwise(url)


def root_slash(url: Column) -> Column:
    """The empty path of an http or https URL becomes ``/``."""
    bare = is_http(url) & (path(url) == "")
    return F.when(bare, compose(scheme(url), netloc(url), F.lit("/"), query(url), fragment(url))).otherwise(url)


def _requote(url: str) -> str:
    """Decode the percent escapes of unreserved characters and encode what a URL may not hold.

    If an escape is not hexadecimal, the percent signs themselves are encoded.
    """
    escapes = re.findall(r"%([0-9A-Za-z]{2})", url)
    legal = "!#$&'()*+,/:;=?@[]~"
    if any(not re.fullmatch("[0-9a-fA-F]{2}", e) for e in escapes):
        return quote(url, safe=legal)
    decoded = re.sub(r"%([0-9a-fA-F]{2})", lambda m: c if (c := chr(int(m[1], 16))) in UNRESERVED else m[0], url)
    return quote(decoded, safe=legal + "%")


_requote_udf = _lift(_requote)


def requote(url: Column) -> Column:
    odd = url.rlike(r"[^A-Za-z0-9\-._~!#$&'()*+,/:;=?@\[\]]")
    return F.when(odd, _requote_udf(F.when(odd, url))).otherwise(url)


_join_udf = _lift(lambda base, relative: _join(base, relative))


def _join(base: str, relative: str) -> str:
    try:
        return urljoin(base, relative)
    except ValueError:
        return relative


def join(base: Column, relative: Column) -> Column:
    """``relative`` resolved against ``base``; plain absolute paths and absolute URLs stay in the JVM."""
    rooted = relative.rlike(r"^/[^/.?#:;\s][^.?#:;\s]*$") & base.rlike(r"^https?://[^/?#]+")
    absolute = relative.rlike(r"^https?://[^/?#.\s][^/?#\s]*/[^.?#;\s]*$")
    done = F.when(rooted, F.concat(F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), relative)).when(absolute, relative)
    return F.when(done.isNotNull(), done).otherwise(_join_udf(F.when(done.isNull(), base), F.when(done.isNull(), relative)))


# Site rules


def single_param(params: dict[str, list[str]], key: str, kind: type = str):
    """The value of a query parameter that occurs exactly once and reads as ``kind``."""
    values = params.get(key, [])
    if len(values) != 1:
        return None
    try:
        return kind(values[0])
    except ValueError:
        return None


#: The forum scripts: the parameters that choose a page, and items a page: fixed values.
_FORUM = {"/viewforum.php": (("f",), 25), "/viewtopic.php": (("t", "p"), 20)}

#: A forum URL that ends with a session id: fixed value.
_WITH_SESSION = r"(https?://[^/]+/[^/]+\.php(?=\?).*)[?&]sid=[0-9a-f]{32}"


def _phpbb(url: str) -> str:
    split = urlsplit(url)
    if split.scheme not in ("http", "https"):
        return url
    params, wanted = parse_qs(split.query), None
    if split.path in _FORUM:
        keys, size = _FORUM[split.path]
        chosen = next(((k, v) for k in keys if (v := single_param(params, k, int)) is not None), None)
        if chosen:
            start = single_param(params, "start", int)
            first = start - start % size if start is not None else 0
            wanted = [chosen] + ([("start", first)] if first else [])
    elif split.path == "/memberlist.php":
        mode = single_param(params, "mode")
        key = {"viewprofile": "u", "group": "g"}.get(mode)
        if key and (v := single_param(params, key, int)) is not None:
            wanted = [("mode", mode), (key, v)]
    if wanted:
        return urlunsplit(split._replace(query=urlencode(wanted)))
    session = re.fullmatch(_WITH_SESSION, url)
    return session[1] if session else url


_phpbb_udf = _lift(_phpbb)


def phpbb(url: Column) -> Column:
    """Keep the parameters that choose a forum page, round its start down, drop session ids."""
    may = url.contains(".php?")
    return F.when(may, _phpbb_udf(F.when(may, url))).otherwise(url)


#: The session id that stands for all of them: fixed value.
_SESSION = "1xh68gok0s4"
#: Where an event holds what differs from visit to visit, and what stands there instead, given the text and the event's own host.
_PINS: dict[tuple[str, ...], Callable[[str, str], str]] = {
    ("properties", "browserSessionId"): lambda text, site: _SESSION,
    ("context", "page", "referrer"): lambda text, site: "",
    ("context", "page", "url"): lambda text, site: re.sub(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?", lambda _: site, text, count=1),
}


def _pinned(tree: object, site: str, at: tuple[str, ...] = ()) -> object:
    """A JSON tree with the pins' texts replaced."""
    if isinstance(tree, dict):
        return {k: _pinned(v, site, (*at, k)) for k, v in tree.items()}
    return _PINS[at](tree, site) if at in _PINS and isinstance(tree, str) else tree


def _substack(url: str) -> str:
    found = re.fullmatch(r"(https?://[^/?#]*)/api/v1/firehose\?([^#]*)(#.*)?", url)
    sent = parse_qs(found[2]) if found else {}
    stamp, packed = single_param(sent, "_", int), single_param(sent, "d")
    if stamp is None or packed is None:
        return url
    try:
        event = json.loads(urlsafe_b64decode(packed))
    except ValueError:
        return url
    if not isinstance(event, dict):
        return url
    coded = urlsafe_b64encode(json.dumps(_pinned(event, found[1])).encode()).decode()
    return f"{found[1]}/api/v1/firehose?{urlencode([('_', stamp), ('d', coded)])}{found[3] or ''}"


_substack_udf = _lift(_substack)


def substack(url: Column) -> Column:
    """Pin the session, referrer and host inside the base64 event of ``/api/v1/firehose``."""
    may = url.contains("/api/v1/firehose?")
    return F.when(may, _substack_udf(F.when(may, url))).otherwise(url)


#: Parameters that change nothing of what is served, when they are a query's only one, with the characters of their values: fixed values.
_IDLE_REPLY = {"replytocom": string.digits}
_IDLE_BAKER = {"tp_image_id": string.digits, "omhide": string.ascii_lowercase}
_BAKER = "https://minimalistbaker.com/"


def _one_param(url: str) -> tuple[str, str, str] | None:
    """Page, name and value of a web address whose query is one parameter."""
    page, mark, query = url.partition("?")
    scheme, apart, rest = page.partition("://")
    name, equals, value = query.partition("=")
    return (page, name, value) if mark and equals and apart and rest and scheme in ("http", "https") else None


def _made_of(text: str, characters: str) -> bool:
    return text != "" and not text.strip(characters)


def _wordpress(url: str) -> str:
    page, name, value = _one_param(url) or (url, "", "")
    if name in _IDLE_REPLY and _made_of(value.removesuffix("/"), _IDLE_REPLY[name]):
        return page
    slashes = value.replace("%2F", "/")
    if name == "post_type" and not slashes.rstrip("/").strip(string.ascii_letters + "_"):
        return f"{page}?{name}={slashes}"
    return url


def _minimalist_baker(url: str) -> str:
    page, name, value = _one_param(url) or (url, "", "")
    return page if url.startswith(_BAKER) and name in _IDLE_BAKER and _made_of(value, _IDLE_BAKER[name]) else url


_wordpress_udf, _minimalist_baker_udf = _lift(_wordpress), _lift(_minimalist_baker)


def wordpress(url: Column) -> Column:
    """Drop ``?replytocom=N``; slashes after ``?post_type=`` stay unescaped."""
    may = url.contains("?replytocom=") | url.contains("?post_type=")
    return F.when(may, _wordpress_udf(F.when(may, url))).otherwise(url)


def minimalist_baker(url: Column) -> Column:
    """Drop ``?tp_image_id=N`` and ``?omhide=word`` on that host."""
    may = url.startswith(_BAKER) & url.contains("?")
    return F.when(may, _minimalist_baker_udf(F.when(may, url))).otherwise(url)


#: The site rules in their order (text to text); a rule that fails leaves the URL as it is.
SITE_RULES: list[Callable[[str], str]] = [_minimalist_baker, _phpbb, _substack, _wordpress]


def register_site_rule(rule: Callable[[str], str]) -> None:
    """Append a rule to the normal form."""
    SITE_RULES.append(rule)


# External URLs, aliases


def format_external(url: Column, prefix: str = EXTERNAL_PREFIX) -> Column:
    return F.concat(F.lit(prefix), url)


def parse_external(url: Column, prefix: str = EXTERNAL_PREFIX) -> Column:
    """The live URL behind an external one; null for others."""
    return F.when(url.startswith(prefix), F.substr(url, F.lit(len(prefix) + 1)))


def apply_aliases(url: Column, aliases: list[tuple[str, str, bool]]) -> Column:
    """The first alias (source prefix, target prefix, external) that fits rewrites the prefix; ``when`` branches are asked in order."""
    done = None
    for source, target, external in aliases:
        new = F.concat(F.lit(target), F.substr(url, F.lit(len(source) + 1)))
        new = format_external(new) if external else new
        fits = url.startswith(source)
        done = F.when(fits, new) if done is None else done.when(fits, new)
    return url if done is None else done.otherwise(url)


def _split(url: str):
    """The parts of a URL; what cannot be parsed is all path."""
    try:
        return urlsplit(url)
    except ValueError:
        return urlsplit("")._replace(path=url)


def _alternatives(url: str, aliases: list[tuple[str, str, bool]], rules: list[Callable[[str], str]]) -> list[str]:
    found, parts = [url], _split(url)

    def changed(**new: str) -> None:
        nonlocal parts
        parts = parts._replace(**new)
        found.append(urlunsplit(parts))

    if parts.fragment:
        changed(fragment="")
    now = urlunsplit(parts)
    if parts.scheme in ("http", "https"):
        if parts.netloc.isascii() and parts.netloc != parts.netloc.lower():
            changed(netloc=parts.netloc.lower())
        if not parts.path:
            changed(path="/")
        now = urlunsplit(parts)
        rules = [_requote, *rules]
    for rule in rules:
        try:
            new = rule(now)
        except Exception:  # a failing rule changes nothing
            continue
        if new != now:
            found.append(now := new)
    for source, target, external in aliases:
        if now.startswith(source):
            new = (EXTERNAL_PREFIX if external else "") + target + now[len(source) :]
            if new != now:
                found.append(new)
            break
    return found


def alternatives(url: Column, aliases: list[tuple[str, str, bool]] = ()) -> Column:
    """The ordered alternatives of a URL, from as written to the normal form.

    Plain URLs that no alias fits are their own normal form, which the JVM
    sees at once; the UDF gets the others.  The site rules known at the call
    are applied.
    """
    rules, known = list(SITE_RULES), list(aliases)
    done = url.rlike(r"^https?://[a-z0-9.\-]+(:[0-9]+)?/[A-Za-z0-9._~/\-]*$")
    for source, _, _ in known:
        done = done & ~url.startswith(source)
    listed = F.pandas_udf(lambda batch: batch.map(lambda u: None if u is None else _alternatives(u, known, rules)), T.ArrayType(T.StringType()))
    return F.when(done, F.array(url)).otherwise(listed(F.when(~done, url)))


def with_alternatives(df, url: str = "url", aliases: list[tuple[str, str, bool]] = (), out: str = "alternatives"):
    return df.withColumn(out, alternatives(F.col(url), aliases))


def normal_form(alternatives: Column) -> Column:
    return F.element_at(alternatives, -1)


# Views of a URL


def domain_prefix(url: Column) -> Column:
    """Scheme and host, no slash; null for other schemes."""
    return F.when(is_http(url), F.concat(scheme(url), F.lit("://"), netloc(url)))


def directory_prefix(url: Column) -> Column:
    """Everything before the path's last slash, with the query kept as it was; null for other schemes."""
    directory = F.when(F.contains(path(url), F.lit("/")), F.regexp_extract(path(url), r"(?s)^(.*)/[^/]*$", 1)).otherwise(path(url))
    return F.when(is_http(url), compose(scheme(url), netloc(url), directory, query(url), fragment(url)))


def display(url: Column, default_prefix: str | None, external_mark: str = "\U0001f310 ") -> Column:
    """External URLs with a mark, others without the default prefix."""
    shown = F.when(url.startswith(EXTERNAL_PREFIX), F.concat(F.lit(external_mark), parse_external(url)))
    if default_prefix:
        # A prefix without a slash gives way where a slash follows.
        fits = url.startswith(default_prefix if default_prefix.endswith("/") else default_prefix + "/")
        shown = shown.when(fits, F.substr(url, F.lit(len(default_prefix) + 1)))
    return shown.otherwise(url)


def _usable(prefix: str | None) -> bool:
    return prefix is not None and not prefix.endswith("/")


def request_url(url: Column, host: str, default_prefix: str | None = None, request_scheme: str = "http") -> Column:
    """Where the archive serves a URL."""
    base = f"{request_scheme}://{host}"
    own = F.concat(F.lit(f"{base}/_/"), scheme(url), F.lit("/"), netloc(url), path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""), F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise(""))
    if not _usable(default_prefix):
        return own
    slash_path = F.substr(url, F.lit(len(default_prefix) + 1))
    short = url.startswith(default_prefix + "/") & ~slash_path.startswith("/_/") & (slash_path != "/404.html")
    return F.when(short, F.concat(F.lit(base), slash_path)).otherwise(own)


def archive_url(request_path: Column, default_prefix: str | None = None) -> Column:
    """The archived URL behind a request path; null if there is none."""
    pattern = r"(?d)^/_/([^/]+)/(.+)$"
    inside = F.concat(F.regexp_extract(request_path, pattern, 1), F.lit("://"), F.regexp_extract(request_path, pattern, 2))
    rest = F.concat(F.lit(default_prefix), request_path) if _usable(default_prefix) else F.lit(None).cast("string")
    return F.when(request_path.rlike(pattern), inside).when(request_path.startswith("/_/"), F.lit(None).cast("string")).otherwise(rest)


def cookie_applies(url: Column, default_prefix: str | None) -> Column:
    return url.startswith(default_prefix + "/") if _usable(default_prefix) else F.lit(False)


def candidates(typed: Column) -> Column:
    """URLs that a typed address may mean, in the order to try them; at least one."""
    t = F.regexp_replace(typed, r"^\s+|\s+$", "")
    bare = scheme(t) == ""
    named = netloc(t) != ""
    host = F.when(bare & ~named, F.regexp_extract(path(t), r"(?s)^([^/]*)", 1)).otherwise(netloc(t))
    rest = F.when(bare & ~named, F.regexp_extract(path(t), r"(?s)^[^/]*/?(.*)$", 1)).otherwise(path(t))
    rest = F.when(rest == "", "/").when((host != "") & ~rest.startswith("/"), F.concat(F.lit("/"), rest)).otherwise(rest)
    twin = F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(F.concat(F.lit("www."), host))
    hosts = F.when(bare & (host != ""), F.array(host, twin)).otherwise(F.array(host))
    schemes = F.when(bare, F.array(F.lit("https"), F.lit("http"))).otherwise(F.array(scheme(t)))
    tail = F.when(query(t) != "", F.concat(F.lit("?"), query(t))).otherwise("")
    made = F.flatten(F.transform(schemes, lambda s: F.transform(hosts, lambda h: F.concat(s, F.when(h != "", F.concat(F.lit("://"), h)).otherwise(":"), rest, tail))))
    return F.when((t == "") | ~scheme(t).isin("", "http", "https"), F.array(t)).otherwise(made)


def is_site_root(typed: Column) -> Column:
    return path(F.element_at(candidates(typed), 1)) == "/"


# Dimensions


def dimensions(url: Column) -> Column:
    """(type, value) pairs whose texts joined are the URL: host, path levels, query parameters.

    ``$/`` in place of the question mark, as exported sites write it, begins
    the query if it stands once, in the last level of a URL without ``?``.
    """
    whole = r"(?d)^(?i:(https?:|ftp:)(//.*))$"
    head, tail = F.regexp_extract(url, whole, 1), F.regexp_extract(url, whole, 2)
    exported = tail.rlike(r"(?s)^(?:(?!\$/)[^?])*\$/[^/?]*$")
    tail = F.when(exported, F.replace(tail, F.lit("$/"), F.lit("?"))).otherwise(tail)
    # The query begins at the first question mark of the last level.
    last = F.regexp_extract(tail, r"([^/]*)$", 1)
    has_query = F.contains(last, F.lit("?"))
    query_ = F.when(has_query, F.regexp_extract(last, r"(?d)^[^?]*\?(.*)$", 1))
    levels_text = F.when(has_query, F.expr("''")).otherwise("")
    levels_text = F.when(has_query, F.substr(tail, F.lit(1), F.length(tail) - F.length(query_) - 1)).otherwise(tail)
    levels = F.transform(F.regexp_extract_all(levels_text, F.lit(r"(/+[^/]*)"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, "^(/+)", 1).alias("type"), F.regexp_extract(x, "^/+([^/]*)$", 1).alias("value")))
    mark = F.when(exported, "$/").otherwise("?")

    def parameter(kv: Column, i: Column) -> Column:
        sep = F.when(i == 0, mark).otherwise("&")
        pair = F.contains(kv, F.lit("="))
        key = F.when(pair, F.concat(F.substring_index(kv, "=", 1), F.lit("="))).otherwise("")
        return F.struct(F.concat(sep, key).alias("type"), F.substr(kv, F.length(key) + 1).alias("value"))

    empty = F.array().cast("array<struct<type:string,value:string>>")
    parameters = F.coalesce(F.transform(F.split(query_, "&"), parameter), empty)
    all_ = F.concat(levels, parameters)
    first = F.transform(all_, lambda d, i: F.struct(F.when(i == 0, F.concat(head, d["type"])).otherwise(d["type"]).alias("type"), d["value"].alias("value")))
    alone = F.array(F.struct(url.alias("type"), F.lit("").alias("value")))
    return F.when(url.rlike(whole), first).otherwise(alone)


def join_dimensions(dims: Column) -> Column:
    return F.array_join(F.transform(dims, lambda d: F.concat(d["type"], d["value"])), "")


def dimension_types(dims: Column) -> Column:
    return F.transform(dims, lambda d: d["type"])


def same_structure(a: Column, b: Column) -> Column:
    return dimension_types(a) == dimension_types(b)


def page_ordinal(dims: Column, pattern_dims: Column, k: Column) -> Column:
    """The number at dimension k (from 0) if all else equals the pattern; null otherwise."""
    others = F.forall(F.transform(dims, lambda d, i: (i == k) | d.eqNullSafe(F.get(pattern_dims, i))), lambda ok: ok)
    value = F.get(dims, k)["value"]
    return F.when(same_structure(dims, pattern_dims) & others & value.rlike("^[0-9]+$"), F.try_to_number(value, F.lit("999999999999999999")).cast("long"))


def page_url(dims: Column, k: Column, ordinal: Column) -> Column:
    return join_dimensions(F.transform(dims, lambda d, i: F.struct(d["type"].alias("type"), F.when(i == k, ordinal.cast("string")).otherwise(d["value"]).alias("value"))))

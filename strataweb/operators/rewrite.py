"""Rewriting of documents for replay: link targets point into the archive.

Every link knows the place where it stands (see :mod:`..functions.documents`),
so a page is rewritten by splicing there, whatever else of it has the same
text.  One Arrow step, nothing is parsed twice or shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import documents, http, urls
from .links import slices


def served_url(base: str, target: str, host: str, default_prefix: str | None, scheme: str = "http") -> str:
    """Where the archive serves the target of a link of page ``base``; fragments and bare schemes stay."""
    if target.startswith("#") or target.lower() in ("http://", "https://"):
        return target
    try:
        split = urlsplit(urljoin(base, target))
    except ValueError:
        return target
    whole = urlunsplit(split)
    if default_prefix and not default_prefix.endswith("/") and whole.startswith(default_prefix + "/"):
        rest = whole[len(default_prefix) :]
        if not rest.startswith("/_/") and rest != "/404.html":
            return f"{scheme}://{host}{rest}"
    return urlunsplit((scheme, host, f"/_/{split.scheme}/{split.netloc}{split.path}", split.query, split.fragment))


def rewritten(base: str, document: str, links: list[dict], host: str, default_prefix: str | None) -> str:
    """One document with its links served from ``host``; a script or style sheet that is served so loses its integrity attribute."""
    holders: dict[tuple, list[tuple[int, int, str]]] = defaultdict(list)
    cuts = []
    for k in links:
        if k["start"] is not None:
            new = served_url(base, k["relative_url"], host, default_prefix)
            if new != k["relative_url"]:
                holders[k["start"], k["end"], k["quote"]].append((k["at"], k["until"], documents.written(new, k["form"])))
                if k["cut_from"] is not None:
                    cuts.append((k["cut_from"], k["cut_until"]))
    return documents.spliced(document, holders, cuts)


def rewrite(docs: DataFrame, host: str, default_prefix: str | None = None, out: str = "_page") -> DataFrame:
    """Adds ``out``: the body of page ``url`` with its ``links`` served from ``host``.

    Null bodies and null links pass through.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole, "body")):
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url", "body", "links"))
            pages = [b if b is None or k is None else rewritten(u, b, k, host, default_prefix) for u, b, k in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pages, pa.string())], schema.names)

    return docs.mapInArrow(batches, schema)


def insert_after(html: Column, addition: Column, places: list[str]) -> Column:
    """``addition`` placed behind the first of the tags that the document has; at its start if none."""
    done = F.concat(addition, html)
    for tag in reversed(places):
        pattern = rf"(?is)^(.*?<{tag}\b[^>]*>)(.*)$"
        done = F.when(html.rlike(pattern), F.concat(F.regexp_extract(html, pattern, 1), addition, F.regexp_extract(html, pattern, 2))).otherwise(done)
    return done


def insert_before_end(html: Column, addition: Column, places: list[str]) -> Column:
    """``addition`` placed before the last end tag of the first of the tags that the document has; as it is if none."""
    done = html
    for tag in reversed(places):
        pattern = rf"(?is)^(.*)(</{tag}\s*>.*?)$"
        done = F.when(html.rlike(pattern), F.concat(F.regexp_extract(html, pattern, 1), addition, F.regexp_extract(html, pattern, 2))).otherwise(done)
    return done


def _attribute_text(value: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
        value = F.replace(value, F.lit(plain), F.lit(coded))
    return value


def insert_head(html: Column, addition: Column) -> Column:
    return insert_after(html, addition, ["head", "html"])


def add_script(html: Column, url: Column) -> Column:
    return insert_head(html, F.concat(F.lit('<script src="'), _attribute_text(url), F.lit('"></script>')))


def add_favicon(html: Column, url: Column) -> Column:
    return insert_head(html, F.concat(F.lit('<link rel="icon" href="'), _attribute_text(url), F.lit('">')))


def add_robots(html: Column, content: str = "none") -> Column:
    """A meta tag that tells crawlers of the archive what not to do."""
    return insert_head(html, F.concat(F.lit('<meta name="robots" content="'), _attribute_text(F.lit(content)), F.lit('">')))


def add_footer(html: Column, footer: Column, mark: str) -> Column:
    """``footer`` at the bottom of the body, unless an element with the id ``mark`` is there already."""
    there = html.rlike(rf"""(?is)<[a-z][^>]*\sid\s*=\s*["']?{re.escape(mark)}["'\s>]""")
    return F.when(there, html).otherwise(insert_before_end(html, footer, ["body", "html"]))


def pin_date(html: Column, date: Column) -> Column:
    """A script tag that pins the page's clock to the Date header, if there is one."""
    url = F.concat(F.lit("/_/pin_date.js?t="), F.unix_timestamp(date).cast("string"))
    return F.when(date.isNotNull(), add_script(html, url)).otherwise(html)


def responses(parsed: DataFrame, host: str, default_prefix: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the archive answers for each capture (url, metadata, body, links): url, request_url, status_code, headers, body, and the capture's columns ``keep``."""
    date = http.http_date(http.first_header(F.col("metadata.headers"), "date"))
    html = http.content_type(F.col("metadata.headers"), F.col("url")) == "text/html"
    request = urls.request_url(F.col("url"), host, default_prefix)
    path = F.regexp_extract(request, r"^https?://[^/]*(/.*)?$", 1)
    headers = F.concat(http.playable(F.col("metadata.headers")), F.array(F.array(F.lit("Cache-Control"), http.cache_control(path))))
    kept = [f"_kept_{c}" for c in keep]
    made = parsed.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), "url", "body", "links", request.alias("request_url"), F.col("metadata.status_code").alias("status_code"), headers.alias("headers"), html.alias("_html"), date.alias("_date"))
    made = rewrite(made, host, default_prefix)
    body = F.when(F.col("_html"), pin_date(F.col("_page"), F.col("_date"))).otherwise(F.col("_page"))
    return made.select("url", "request_url", "status_code", "headers", body.alias("body"), *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)))

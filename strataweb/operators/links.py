"""Typed links of archived documents.

One Arrow step takes each body apart and emits its finished links: typed,
resolved, and with the place where each stands, so that rewriting can splice
there.  What the step is for, and which rows it sees, is decided by expressions
before it; nothing is shuffled.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import documents, http
from ..functions.documents import PROBABLY_EMBEDDED  # noqa: F401

LINK_TYPE = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("relative_url", "type_title", "title")),
        T.StructField("embedded", T.BooleanType()),
        *(T.StructField(c, T.StringType()) for c in ("tag", "attr", "target_url")),
        *(T.StructField(c, T.IntegerType()) for c in ("start", "end")),
        T.StructField("quote", T.StringType()),
        *(T.StructField(c, T.IntegerType()) for c in ("at", "until")),
        T.StructField("form", T.StringType()),
        *(T.StructField(c, T.IntegerType()) for c in ("cut_from", "cut_until")),
    ]
)
_ARROW = pa.struct([(f.name, {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[f.dataType.simpleString()]) for f in LINK_TYPE])
#: Links that stay as they are, and are not reported: fixed values.
_UNREWRITABLE = ("mailto:", "javascript:", "data:")
_FAVICON = "/favicon.ico"
_PAGES = ("html", "frames")
#: What precedes the pager's JSON: fixed value.
_PAGER = "window.FWP_JSON ="
#: Bytes of bodies that are taken apart at once: their links are many times as large as Python objects.
SLICE_BYTES = 256 << 10
_TAGS = "array<struct<tag:string,attributes:array<struct<name:string,value:string>>,text:string>>"

#: Changes the links of a document: (url, kind, body, links) to links.
Rule = Callable[[str, str, str, list[documents.Link]], list[documents.Link]]


def links_of(kind: str | None, url: str | None, body: str | None, root: bool = False, rules: tuple[Rule, ...] = ()) -> list[documents.Link]:
    """The links of one document: those of its text, an implicit icon at a site's root, then what the rules make of them."""
    if kind not in documents.KINDS or body is None:
        return []
    found = documents.KINDS[kind](body)
    if root and kind in _PAGES and not any(k.type_title == "Icon" for k in found):
        found.append(documents.Link(_FAVICON, "Icon", None, True, "html", "implicit", *(None,) * 7))
    found = [k for k in found if not k.relative_url.startswith(_UNREWRITABLE)]
    for rule in rules:
        found = rule(url, kind, body, found)
    return [k._replace(target_url=documents.target(url, k.relative_url)) for k in found]


def slices(batch: pa.RecordBatch, *texts: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of its columns ``texts``, one row at least."""
    sizes = [pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(c))), 0).to_numpy(zero_copy_only=False) for c in texts]
    # A row counts a little itself, so that rows without text are many but not all at once.
    ends = np.cumsum(np.sum(sizes, axis=0, dtype=np.int64) + 64)
    at, gone = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, gone + (most or SLICE_BYTES), "right")))
        yield batch.slice(at, to - at)
        at, gone = to, int(ends[to - 1])


def with_links(captures: DataFrame, out: str = "links", rules: tuple[Rule, ...] = ()) -> DataFrame:
    """Adds the ordered links of each capture (url, metadata, body as text, or as bytes that are decoded first).

    Binary types and captures without a body are set aside before anything is
    parsed.  A redirect is the last link.  ``rules`` see each document's links
    before that.
    """
    headers, status = F.col("metadata.headers"), F.col("metadata.status_code")
    kind = http.document_kind(http.content_type(headers, F.col("url")))
    frames = (kind == "html") & F.lower("body").contains("<frameset")
    moved, why = http.redirect_url(status, headers), http.redirect_title(status, F.col("metadata.reason_phrase"))
    root = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1) == "/"
    own = {"_link_kind": F.when(frames, "frames").otherwise(kind), "_link_root": root, "_link_moved": moved, "_link_why": why}
    names = ["url", "body", "_link_kind", "_link_root", "_link_moved", "_link_why"]
    binary = isinstance(captures.schema["body"].dataType, T.BinaryType)
    if binary:
        # Bodies without links are not decoded, those of other charsets by the step that takes them apart.
        charset, text = F.coalesce(*_charsets(F.col("body"), headers, detect=True)), _without_mark(F.col("body").cast("string"))
        other = kind.isNotNull() & _is_other(charset)
        own["_link_text"], own["_link_charset"] = F.when(kind.isNotNull() & ~other, text), F.when(other, charset)
        own["_link_kind"] = F.when((kind == "html") & F.lower("_link_text").contains("<frameset"), "frames").otherwise(kind)
        names[1:2] = ["_link_text", "body", "_link_charset"]
    first = {c: own.pop(c) for c in ("_link_text", "_link_charset") if c in own}
    work, n_own = captures.drop(out).withColumns(first).withColumns(own), len(first) + len(own)
    schema = T.StructType([*captures.drop(out).schema.fields, T.StructField(out, T.ArrayType(LINK_TYPE))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "body")):
            found, ends = [], [0]
            for url, body, *data, kind, root, moved, why in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                if binary and data[1] is not None:
                    body = _decoded(*data).removeprefix("\ufeff")
                    kind = "frames" if kind == "html" and "<frameset" in body.lower() else kind
                found += links_of(kind, url, body, bool(root), rules)
                if moved is not None:
                    found.append(documents.Link(moved, "Redirect", why, True, "http", "location", documents.target(url, moved), *(None,) * 6))
                ends.append(len(found))
            fields = list(zip(*found, strict=True)) or [()] * len(_ARROW)
            flat = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(fields, _ARROW, strict=True)], [f.name for f in _ARROW])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-n_own], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], schema.names)

    return work.mapInArrow(parse, schema)


def paginator(url: str, kind: str, body: str, found: list[documents.Link]) -> list[documents.Link]:
    """A rule for pages of minimalistbaker.com: the pages of the list whose pager a script holds as JSON."""
    if kind != "html" or url is None or not url.startswith("https://minimalistbaker.com/") or _PAGER not in body:
        return found
    split = urlsplit(url)
    for e in documents.elements(body):
        if e.tag != "script" or e.text is None or _PAGER not in e.text.text:
            continue
        try:
            data, _ = json.JSONDecoder().raw_decode(e.text.text.partition(_PAGER)[2].lstrip())
        except ValueError:
            continue
        held = data.get("preload_data") if isinstance(data, dict) else None
        pager = held.get("pager") if isinstance(held, dict) else None
        for page in documents.elements(pager) if isinstance(pager, str) else ():
            number = page.attrs.get("data-page")
            if page.tag == "a" and number is not None:
                query = {k: v for k, v in parse_qsl(split.query) if k != "fwp_paged"} | ({} if number.text == "1" else {"fwp_paged": number.text})
                relative = urlunsplit(("", "", split.path, urlencode(query), split.fragment))
                found = [*found, documents.Link(relative, "Paginator Reference", number.text, False, "script", "string", *(None,) * 7)]
    return found


def find_tags(docs: DataFrame, html: str, tag: str | None = None, attribute: str | None = None, equals: str | None = None, matches: str | None = None) -> DataFrame:
    """One row a tag that fits, with ``docs``' other columns: pos (from 0 within the document), tag, attributes and text.

    A tag fits if it is named ``tag``, has the attribute, and the attribute's
    value equals or matches (a regular expression anywhere in it) what is given.
    """
    rest = [c for c in docs.columns if c != html]
    fits = F.lit(True)
    if tag is not None:
        fits &= F.col("e.tag") == tag.lower()
    if attribute is not None:
        value = F.try_element_at(F.map_from_entries("e.attributes"), F.lit(attribute.lower()))
        fits &= value.isNotNull()
        fits = fits & (value == equals) if equals is not None else fits
        fits = fits & value.rlike(matches) if matches is not None else fits
    parse = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else [{"tag": e.tag, "attributes": [{"name": k, "value": v.text} for k, v in e.attrs.items()], "text": e.text.text if e.text else None} for e in documents.elements(t)]), _TAGS)
    return docs.select(*rest, F.posexplode(parse(F.col(html))).alias("pos", "e")).where(fits).select(*rest, "pos", "e.tag", F.map_from_entries("e.attributes").alias("attributes"), "e.text")


def html_links(html: Column) -> Column:
    """The links of an HTML text, not resolved."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: [k._asdict() for k in documents.html_links(t)] if t is not None else None), T.ArrayType(LINK_TYPE))(html)


def explode_links(parsed: DataFrame, links: str = "links") -> DataFrame:
    """One row a link: the other columns, pos (from 0), and the link's type, texts and target_url."""
    rest = [c for c in parsed.columns if c != links]
    rows = parsed.select(*rest, F.posexplode(links).alias("pos", "link"))
    return rows.select(*rest, "pos", *(F.col(f"link.{c}") for c in ("relative_url", "type_title", "title", "embedded", "tag", "attr", "target_url")))


def full_title(link: Column) -> Column:
    return F.when(link["title"].isNotNull(), F.concat_ws(": ", link["type_title"], link["title"])).otherwise(link["type_title"])


def by_target(links: DataFrame) -> DataFrame:
    """Links of a page grouped by target: first place, number, titles in order, whether any is embedded."""
    title = F.when(F.col("title").isNotNull(), F.concat_ws(": ", "type_title", "title")).otherwise(F.col("type_title"))
    grouped = links.groupBy("url", "target_url").agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_links"), F.array_sort(F.collect_list(F.struct("pos", title.alias("title")))).alias("_titles"), F.bool_or("embedded").alias("any_embedded")
    )
    return grouped.withColumn("titles", F.array_join(F.transform("_titles", lambda t: t["title"]), ", ")).drop("_titles")


def _decoded(data: bytes, charset: str) -> str:
    try:
        codecs.lookup(charset)
    except LookupError:
        charset = "utf-8"
    return data.decode(charset, errors="replace")


_decode_udf = F.pandas_udf(lambda bodies, names: pd.Series([None if b is None or n is None else _decoded(b, n) for b, n in zip(bodies, names, strict=True)], dtype=object), T.StringType())


def decode(body: Column, headers: Column | None = None, detect: bool = False) -> Column:
    """The text of a binary body in its declared charset, with ``detect`` else in the one it names itself; UTF-8 if none (or one that is unknown) is named.

    Malformed bytes are replaced, a byte-order mark is left out where charsets
    are detected.  Only bodies in other charsets leave the JVM.
    """
    plain = body.cast("string")
    named = _charsets(body, headers, detect)
    if not named:
        return plain
    charset = F.coalesce(*named)
    other = _is_other(charset)
    text = F.when(other, _decode_udf(F.when(other, body), F.when(other, charset))).otherwise(plain)
    return _without_mark(text) if detect else text


def _charsets(body: Column, headers: Column | None, detect: bool) -> list[Column]:
    """The charsets of a body, the one that counts first."""
    return ([F.lower(http.declared_charset(headers))] if headers is not None else []) + ([http.detected_charset(body)] if detect else [])


def _is_other(charset: Column) -> Column:
    return charset.isNotNull() & ~charset.isin("utf-8", "utf8", "us-ascii", "ascii")


def _without_mark(text: Column) -> Column:
    return F.regexp_replace(text, "^\ufeff", "")

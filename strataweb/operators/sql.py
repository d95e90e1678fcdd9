"""Table functions for SQL text: links and tags of documents, by lateral joins.

    SELECT p.id, l.target_url
    FROM captures p, LATERAL document_links(p.url, 'html', p.body) l

They belong to the session that :func:`register` is called with, and so do the
rules given there: another session may have others.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import documents
from .links import Rule, links_of

LINKS = "pos int, relative_url string, type_title string, title string, embedded boolean, tag string, attr string, target_url string"
TAGS = "pos int, tag string, attributes map<string,string>, text string"


def register(spark: SparkSession, rules: tuple[Rule, ...] = (), prefix: str = "") -> None:
    """Make ``document_links`` (url, kind, body) and ``document_tags`` (body) known to the session's SQL, named with ``prefix``.

    ``kind`` is html, css, json or xml; documents of other kinds, null kinds and
    null bodies have no links.  ``rules`` change each document's links.
    """

    class DocumentLinks:
        def eval(self, url: str, kind: str, body: str) -> Iterator[tuple]:
            if kind == "html" and body is not None and "<frameset" in body.lower():
                kind = "frames"
            for pos, k in enumerate(links_of(kind, url, body, rules=rules)):
                yield pos, k.relative_url, k.type_title, k.title, k.embedded, k.tag, k.attr, k.target_url

    class DocumentTags:
        def eval(self, body: str) -> Iterator[tuple]:
            for pos, e in enumerate(documents.elements(body or "")):
                yield pos, e.tag, {k: v.text for k, v in e.attrs.items()}, e.text.text if e.text else None

    spark.udtf.register(f"{prefix}document_links", F.udtf(DocumentLinks, returnType=LINKS))
    spark.udtf.register(f"{prefix}document_tags", F.udtf(DocumentTags, returnType=TAGS))

"""URL functions against known answers."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweb.functions import patterns, urls


def values(spark, texts, f):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, url string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("url"))).collect()]


def test_alternatives_go_from_written_to_normal(spark):
    cases = {
        "https://xkcd.com/": ["https://xkcd.com/"],
        "https://xkcd.com#hello": ["https://xkcd.com#hello", "https://xkcd.com", "https://xkcd.com/"],
        "https://xkcd.com/1/#footer": ["https://xkcd.com/1/#footer", "https://xkcd.com/1/"],
        "https://XKCD.com/1/": ["https://XKCD.com/1/", "https://xkcd.com/1/"],
        "https://xkcd.com/old archive/": ["https://xkcd.com/old archive/", "https://xkcd.com/old%20archive/"],
        "HTTP://x.com/": ["HTTP://x.com/"],
        "http://x.com/%7Ea%zz": ["http://x.com/%7Ea%zz", "http://x.com/%257Ea%25zz"],
        "http://x.com/%7Ea%2f": ["http://x.com/%7Ea%2f", "http://x.com/~a%2f"],
        "http://[bad": ["http://[bad"],
    }
    assert values(spark, list(cases), urls.alternatives) == list(cases.values())


def test_aliases_first_match_and_external(spark):
    aliases = [("https://old-domain.com/", "https://new-domain.com/", False), ("https://old-domain.com/p", "https://no/", False), ("https://archive.local/", "https://live.example.com/", True)]
    found = values(spark, ["https://old-domain.com/page", "https://archive.local/resource", "https://x.org/"], lambda u: urls.normal_form(urls.alternatives(u, aliases)))
    assert found == ["https://new-domain.com/page", "archive://external/https://live.example.com/resource", "https://x.org/"]
    assert values(spark, ["archive://external/https://example.com/page", "https://a.b/"], urls.parse_external) == ["https://example.com/page", None]


@pytest.mark.parametrize(
    ("pattern", "url", "member"),
    [
        ("https://xkcd.com/#/", "https://xkcd.com/1/", True),
        ("https://xkcd.com/#/", "https://xkcd.com/about", False),
        ("https://x.com/*", "https://x.com/a?b", False),
        ("https://x.com/**", "https://x.com/a?b=c/d", True),
        ("https://x.com/a.b$|@", "https://x.com/a.b$|@", True),
        ("https://x.com/a.b", "https://x.com/aXb", False),
        ("https://x.com/**", "https://x.com/a b", True),
    ],
)
def test_patterns(spark, pattern, url, member):
    assert values(spark, [url], lambda u: patterns.matches(u, pattern)) == [member]


def test_at_is_literal_unless_asked(spark):
    assert values(spark, ["http://x/abc"], lambda u: patterns.matches(u, "http://x/@")) == [False]
    assert values(spark, ["http://x/abc"], lambda u: patterns.matches(u, "http://x/@", at_wildcard=True)) == [True]


def test_join_as_python_does(spark):
    from urllib.parse import urljoin

    bases = ["https://a.b/c/d?q#f", "http://h", "http://h/x/"]
    relatives = ["/r", "r/s", "../t", "?q=1", "//other/x", "https://z.y/w", "#f", "/a/../b", "", "/x:y", "/é ü"]
    cases = [(b, r) for b in bases for r in relatives]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, b string, r string")
    assert [x[0] for x in df.orderBy("k").select(urls.join(F.col("b"), F.col("r"))).collect()] == [urljoin(*c) for c in cases]


def test_dimensions(spark):
    cases = {
        "https://a.b/c/d.html?x=1&y": [("https://", "a.b"), ("/", "c"), ("/", "d.html"), ("?x=", "1"), ("&", "y")],
        "http://a.b": [("http://", "a.b")],
        "http://a.b//c/": [("http://", "a.b"), ("//", "c"), ("/", "")],
        "mailto:x": [("mailto:x", "")],
        "http://a.b/c$/x=1": [("http://", "a.b"), ("/", "c"), ("$/x=", "1")],
    }
    found = values(spark, list(cases), urls.dimensions)
    assert [[(d["type"], d["value"]) for d in dims] for dims in found] == list(cases.values())


def test_dimensions_round_trip(spark):
    texts = []

    @given(st.text(alphabet="ab/?=&$#é.", max_size=20))
    def collect(t):
        texts.append("https://h" + t)

    collect()
    texts = sorted(set(texts))
    assert values(spark, texts, lambda u: urls.join_dimensions(urls.dimensions(u))) == texts


def test_archive_url_inverts_request_url(spark):
    texts = ["https://x.org/a/b?c=d", "http://y.org/", "https://site.test/p"]
    back = values(spark, texts, lambda u: urls.archive_url(F.regexp_replace(urls.request_url(u, "h:1", "https://site.test"), "^http://h:1", ""), "https://site.test"))
    assert back == texts


def test_nulls_stay_null(spark):
    for f in (urls.strip_fragment, urls.requote, urls.phpbb, urls.substack, urls.domain_prefix, urls.parse_external):
        assert values(spark, [None], f) == [None]

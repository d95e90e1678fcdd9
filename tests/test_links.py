"""Link rules, their places and rewriting against known bodies."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataweb.functions import documents, http
from strataweb.operators import links, rewrite, sql

CASES = [
    ('<style>@import "tide.css"; /* url(no.png) */</style>', [("tide.css", "CSS @import", None, True)]),
    ("""<p style="color: red; background: url('./pier.gif')">x</p>""", [("./pier.gif", "CSS URL Reference", None, True)]),
    ('<table background=" sand.jpg "></table>', [("sand.jpg", "Background Image", None, True)]),
    ('<img src="crab.png" title="A crab">', [("crab.png", "Image", "A crab", True)]),
    ('<img src="crab.png" title="A crab" alt="Alt first">', [("crab.png", "Image", "Alt first", True)]),
    ('<iframe src="map.htm" name="map"></iframe>', [("map.htm", "IFrame", "map", True)]),
    ('<frame src="left.htm" name="left">', [("left.htm", "Frame", "left", True)]),
    ('<input type="image" src="go.png" alt="Go">', [("go.png", "Form Image", "Go", True)]),
    ('<input type="text" src="go.png" alt="Go">', [("go.png", "Unknown Embedded (input)", None, True)]),
    ('<video src="sea.mp4"></video>', [("sea.mp4", "Unknown Embedded (video)", None, True)]),
    ('<img srcset="s1.png 1x,s2.png 2x , data:a,b 3x" alt="Set">', [("s1.png", "Image", "Set", True), ("s2.png", "Image", "Set", True)]),
    ('<a href="https://harbour.test">Harbour</a>', [("https://harbour.test", "Link", "Harbour", False)]),
    ("<a href=plain title=x>Plain</a>", [("plain", "Link", "Plain", False)]),
    ('<link rel="stylesheet" href="look">', [("look", "Stylesheet", None, True)]),
    ('<link type="text/css" href="look">', [("look", "Stylesheet", None, True)]),
    ('<link rel="apple-touch-icon" href="touch">', [("touch", "Icon", None, True)]),
    ('<link rel="preload" href="font.woff">', [("font.woff", "Preload", None, True)]),
    ('<link rel="prev" href="a?x.css">', [("a?x.css", "Unknown Link (rel=prev)", None, False)]),
    ('<link href="bare">', [("bare", "Unknown Href (link)", None, False)]),
    ('<area href="bay.htm">', [("bay.htm", "Unknown Href (area)", None, False)]),
    ("""<button onclick='document.location.href = "/boats"; ' value='Boats'>""", []),
    ("""<button onclick='document.location.href = "/boats";' value='Boats'>""", [("/boats", "Clickable", "Boats", False)]),
    ("""<a href="oars.htm" onclick="top.location='oar.htm'">Oars</a>""", [("oars.htm", "Link", "Oars", False), ("oar.htm", "Clickable", None, False)]),
    ('<script>load("https://cdn.test/x.js?v=2", \'//img.test/y\');</script>', [("https://cdn.test/x.js?v=2", "Script Reference", None, True), ("//img.test/y", "Script Reference", None, False)]),
    ('<script type="TEXT/JavaScript">u = "http:\\/\\/y.test\\/p.png"</script>', [("http://y.test/p.png", "Script Reference", None, True)]),
    ('<script type="text/template">["http://y.test/"]</script>', []),
    ('<script>a = "///no"; b = "//"; c = "/one"</script>', []),
    ('<div data-bg="https://y.test/w.JPG">x</div>', [("https://y.test/w.JPG", "Attribute Reference", None, True)]),
    ('<a href="?a=1&amp;b=2">x<b>y</b></a><script>var t="</p>";</script>', [("?a=1&b=2", "Link", "x", False)]),
    ('<img src="a.png"><source srcset="b.png"><a href="c">', [("b.png", "Image Source", None, True), ("a.png", "Image", None, True), ("c", "Link", None, False)]),
    ('<picture><source srcset="w1.png 1x, w2.png 2x" alt="no" title="none"><img srcset="w3.png"></picture>', [("w1.png", "Image Source", None, True), ("w2.png", "Image Source", None, True), ("w3.png", "Image", None, True)]),
    ('<!-- <a href="hidden"> --><A HREF="shown">s<!-- note -->een</A>', [("shown", "Link", "seen", False)]),
    ('<a href="one" href="two">once</a><textarea><a href="typed"></textarea>', [("one", "Link", "once", False)]),
    ('<a title="open href=x', []),
    ("", []),
]


@pytest.mark.parametrize("body,wanted", CASES)
def test_html_links(body, wanted):
    found = [k for k in documents.html_links(body) if not k.relative_url.startswith("data:")]
    assert [(k.relative_url, k.type_title, k.title, k.embedded) for k in found] == wanted
    for k in found:  # the place holds the link
        raw = body[k.start : k.end]
        text = raw if k.quote is None else documents.unescape(raw)
        assert text[k.at : k.until].replace("\\/", "/") == k.relative_url


SHEETS = [
    ('@import "a.css"; @import \'b.css\' screen; b { c: url(d.png) }', [("a.css", "CSS @import"), ("b.css", "CSS @import"), ("d.png", "CSS URL Reference")]),
    ('@import url(a.css); @import url("b.css"); @IMPORT "c.css"; @charset "d"; @font-face { src: url(e.woff) format("x"), url(\'f.woff\') }', [("e.woff", "CSS URL Reference"), ("f.woff", "CSS URL Reference")]),
    ('a { content: "url(no.png)"; b: "\\"url(no.png)"; c: url(yes.png) }', [("yes.png", "CSS URL Reference")]),
    ("@media x { a { b: url(no.png) } } c { d: url(yes.png) }", [("yes.png", "CSS URL Reference")]),
    ("@page { margin: 1px; background: url(yes.png) }", [("yes.png", "CSS URL Reference")]),
    ('a { b: image-set(url(no.png) 1x, "no.png" 2x), [url(no.png)], url(yes.png) }', [("yes.png", "CSS URL Reference")]),
    ('a { b: url( "no.png" ); c: url("no.png" x); d: url(  yes.png  ); e: URL(\'two.png\') }', [("yes.png", "CSS URL Reference"), ("two.png", "CSS URL Reference")]),
    ("a { b: url(a b.png); c: url(x'y); d: myurl(no.png); e: url(yes.png) }", [("yes.png", "CSS URL Reference")]),
    ('a { b: url(sp\\61 ce\\ d.png); c: url("q\\"r.png") }', [("space d.png", "CSS URL Reference"), ('q"r.png', "CSS URL Reference")]),
    ('url(no.png) a[href="url(no.png)"] { b: url() } /* c { d: url(no.png) } */ e { f: url(last.png)', [("", "CSS URL Reference"), ("last.png", "CSS URL Reference")]),
    ('a { b: "open\n; c: url(yes.png) } ) ] } d { e: url(two.png) }', [("yes.png", "CSS URL Reference"), ("two.png", "CSS URL Reference")]),
    ("", []),
    ("@import", []),
]


@pytest.mark.parametrize("sheet,wanted", SHEETS)
def test_css_links(sheet, wanted):
    found = list(documents.css_spans(sheet))
    assert [(u, kind) for u, kind, _, _ in found] == wanted
    assert all(documents._css_text(sheet[a:b]) == u for u, _, a, b in found)


@pytest.mark.parametrize(
    "style,wanted",
    [
        ("background: url(a.png); b: url('c.png') d", ["a.png", "c.png"]),
        ("a: 'url(no.png)'; b: f(url(no.png)); url(no.png); @x url(no.png); c: url(yes.png) !important", ["yes.png"]),
        ("a: {b: url(no.png)}; c: d:url(yes.png)", ["yes.png"]),
        ("url: url(yes.png)", ["yes.png"]),
        ("", []),
    ],
)
def test_style_attributes(style, wanted):
    assert [u for u, _, _, _ in documents.css_spans(style, declarations=True)] == wanted


HOST = "arc.test"
PAGES = [
    ('<p title="b"><a href="b">b</a><script>var t="b", u="http:\\/\\/y.test\\/p.png";</script>', '<p title="b"><a href="http://arc.test/_/https/x.test/d/b">b</a><script>var t="b", u="http://arc.test/_/http/y.test/p.png";</script>'),
    ('<img srcset="s1.png 1x, s2.png 2x" alt="s1.png">', '<img srcset="http://arc.test/_/https/x.test/d/s1.png 1x, http://arc.test/_/https/x.test/d/s2.png 2x" alt="s1.png">'),
    ("<a href=plain>plain</a>", '<a href="http://arc.test/_/https/x.test/d/plain">plain</a>'),
    ("<a href='?q=1&amp;r=\"2\"'>q</a>", "<a href='http://arc.test/_/https/x.test/d/p?q=1&amp;r=\"2\"'>q</a>"),
    ("""<p style="background: url(&quot;i.png&quot;)">i.png</p>""", """<p style="background: url(&quot;http://arc.test/_/https/x.test/d/i.png&quot;)">i.png</p>"""),
    ("<style>a { background: url(i.png) } /* url(i.png) */</style>", "<style>a { background: url(http://arc.test/_/https/x.test/d/i.png) } /* url(i.png) */</style>"),
    ("""<b onclick="self.location='/go';">/go</b>""", """<b onclick="self.location='http://arc.test/_/https/x.test/go';">/go</b>"""),
    ('<a href="#top">#top</a><a href="http://">http://</a>', '<a href="#top">#top</a><a href="http://">http://</a>'),
    ('<script integrity="sha1-x" src="/s.js"></script><i integrity="kept">', '<script src="http://arc.test/_/https/x.test/s.js"></script><i integrity="kept">'),
    ('<script integrity="kept">x</script><link rel=icon integrity=y href=i><link integrity="kept" href="#a">', '<script integrity="kept">x</script><link rel=icon href="http://arc.test/_/https/x.test/d/i"><link integrity="kept" href="#a">'),
    ("<a href=\"a\">1</a> <a href=\"http://arc.test/_/https/x.test/d/a\">2</a>", "<a href=\"http://arc.test/_/https/x.test/d/a\">1</a> <a href=\"http://arc.test/_/http/arc.test/_/https/x.test/d/a\">2</a>"),
    ("no links at all", "no links at all"),
]


def captures(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, url string, body string, kind string")
    headers = F.array(F.array(F.lit("content-type"), F.col("kind")))
    return df.withColumn("metadata", F.struct(F.lit(200).alias("status_code"), F.lit("OK").alias("reason_phrase"), headers.alias("headers")))


def test_pages_are_rewritten_where_links_stand(spark):
    rows = captures(spark, [("https://x.test/d/p", body, "text/html") for body, _ in PAGES])
    done = rewrite.responses(links.with_links(rows), HOST).collect()
    assert [r["body"] for r in done] == [w for _, w in PAGES]


OTHERS = [
    ("text/css", '@import "a.css"; b { c: url( d.png ) }', '@import "http://arc.test/_/https/x.test/a.css"; b { c: url( http://arc.test/_/https/x.test/d.png ) }'),
    ("application/json", '{"http://y.test/": ["https:\\/\\/y.test\\/a\\"b", "no"]}', '{"http://arc.test/_/http/y.test/": ["http://arc.test/_/https/y.test/a\\"b", "no"]}'),
    ("application/rss+xml", "<rss><link> https://y.test/?a&amp;b </link><x href='k'/></rss>", "<rss><link> http://arc.test/_/https/y.test/?a&amp;b </link><x href='k'/></rss>"),
    ("application/atom+xml", '<feed><link rel="self" href="/f"/></feed>', '<feed><link rel="self" href="http://arc.test/_/https/x.test/f"/></feed>'),
    ("application/rss+xml", "<rss><link><![CDATA[/c?a&b]]></link></rss>", "<rss><link><![CDATA[http://arc.test/_/https/x.test/c?a&b]]></link></rss>"),
    ("text/html", "<frameset><frame src='l.html'></frameset>", "<frameset><frame src='http://arc.test/_/https/x.test/l.html'></frameset>"),
    ("image/png", "<a href='x'>", "<a href='x'>"),
]


def test_other_documents_are_rewritten(spark):
    rows = captures(spark, [("https://x.test/", body, kind) for kind, body, _ in OTHERS])
    assert [r["body"] for r in rewrite.responses(links.with_links(rows), HOST).collect()] == [w for *_, w in OTHERS]


def test_rewriting_random_pages_changes_links_only():
    r = random.Random(12)
    parts = ['<a href="{u}">{u}</a>', "<a href={u}>x</a>", "<img src='{u}' srcset=\"{u} 1x, {u}b 2x\">", '<p title="{u}">{u}</p>', "<script>v('{u}')</script>", "<style>a{{b:url({u})}}</style>", "&amp; {u} <", "<!-- {u} -->", "text"]
    for _ in range(300):
        body = "".join(r.choice(parts).format(u=r.choice(["a", "/b?c=1&amp;d", "https://y.test/q", "//z.test/k.js"])) for _ in range(r.randint(0, 8)))
        found = links.links_of("html", "https://x.test/", body)
        done = rewrite.rewritten("https://x.test/", body, [k._asdict() for k in found], HOST, None)
        again = links.links_of("html", "https://x.test/", done)
        assert [k.type_title for k in again] == [k.type_title for k in found]
        assert [k.relative_url for k in again] == [rewrite.served_url("https://x.test/", k.relative_url, HOST, None) for k in found]
        # Back to the old texts, the page is the old one but for added quotes.
        holders = {}
        for old, new in zip(found, again, strict=True):
            holders.setdefault((new.start, new.end, new.quote), []).append((new.at, new.until, old.relative_url))
        plain = lambda t: t.replace('"', "").replace("&amp;", "&")
        assert plain(documents.spliced(done, holders)) == plain(body)


@pytest.mark.parametrize("kind", ["text/html", "text/css", "application/json", "application/rss+xml", "image/png"])
def test_empty_and_missing_bodies(spark, kind):
    rows = captures(spark, [("http://x/a", "", kind), ("http://x/a", None, kind), (None, "", kind)])
    assert [r["links"] for r in links.with_links(rows).collect()] == [[], [], []]


def test_icons_redirects_and_rules(spark):
    rows = captures(spark, [("https://x.test/", "<p>", "text/html"), ("https://x.test/a", "<p>", "text/html"), ("https://x.test/", '<link rel="icon" href="i">', "text/html")])

    def no_icons(url, kind, body, found):
        return [k for k in found if k.type_title != "Icon"]

    assert [[k["relative_url"] for k in r["links"]] for r in links.with_links(rows).collect()] == [["/favicon.ico"], [], ["i"]]
    assert [r["links"] for r in links.with_links(rows, rules=(no_icons,)).collect()] == [[], [], []]
    moved = F.struct(F.lit(301).alias("status_code"), F.lit("Gone on").alias("reason_phrase"), F.array(F.array(F.lit("Location"), F.lit("/n"))).alias("headers"))
    found = links.explode_links(links.with_links(rows.limit(1).withColumn("body", F.lit(None).cast("string")).withColumn("metadata", moved)).select("url", "links")).collect()
    assert [(r["relative_url"], r["type_title"], r["title"], r["embedded"], r["target_url"]) for r in found] == [("/n", "Redirect", "301 Gone on", True, "https://x.test/n")]


def test_bodies_in_their_charset(spark):
    rows = [("text/html; charset=Windows-1252", "café “x”".encode("cp1252")), ("text/html; charset=shift_jis", "漢字".encode("shift_jis")), ("text/html; charset=nonsense", "é".encode()), ("text/html", "é".encode()), ("text/html; charset=utf-8", b"\xff"), ("text/html; charset=latin1", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, kind string, body binary")
    headers = F.array(F.array(F.lit("Content-Type"), F.col("kind")))
    found = [r["text"] for r in df.select(links.decode(F.col("body"), headers).alias("text")).collect()]
    assert found == ["café “x”", "漢字", "é", "é", "�", None]


DETECTED = [
    ("<meta charset=Windows-1252>é".encode("cp1252"), "windows-1252", "<meta charset=Windows-1252>é"),
    ('<META http-equiv="x" content="text/html; charset=shift_jis">漢'.encode("shift_jis"), "shift_jis", '<META http-equiv="x" content="text/html; charset=shift_jis">漢'),
    ("\ufeff<meta charset=latin1>é".encode("utf-16-le"), "utf-16le", "<meta charset=latin1>é"),
    ("\ufeffé".encode("utf-16-be"), "utf-16be", "é"),
    ("\ufeff<meta charset=latin1>é".encode(), "utf-8", "<meta charset=latin1>é"),
    ('<!-- <meta charset="cp1252"> --><meta charset="utf-16">é'.encode(), "utf-8", '<!-- <meta charset="cp1252"> --><meta charset="utf-16">é'),
    ('<?xml version="1.0" encoding="iso-8859-1"?>é'.encode("latin1"), "iso-8859-1", '<?xml version="1.0" encoding="iso-8859-1"?>é'),
    ('@charset "iso-8859-1";é'.encode("latin1"), "iso-8859-1", '@charset "iso-8859-1";é'),
    (b" " * 1024 + "<meta charset=latin1>é".encode(), None, " " * 1024 + "<meta charset=latin1>é"),
    (b"<metal charset=latin1><meta name=charset>", None, "<metal charset=latin1><meta name=charset>"),
    (b"<meta charset=nonsense>\xc3\xa9", "nonsense", "<meta charset=nonsense>é"),
    (b"", None, ""),
    (None, None, None),
]


def test_charsets_that_bodies_name(spark):
    df = spark.createDataFrame([(k, b) for k, (b, _, _) in enumerate(DETECTED)], "k int, body binary")
    found = df.select(http.detected_charset(F.col("body")), links.decode(F.col("body"), detect=True)).collect()
    assert [tuple(r) for r in found] == [(c, t) for _, c, t in DETECTED]
    declared = F.array(F.array(F.lit("Content-Type"), F.lit("text/html; charset=latin1")))
    assert df.limit(1).select(links.decode(F.col("body"), declared, detect=True)).first()[0] == DETECTED[0][2]


def test_links_of_bytes_are_those_of_their_text(spark):
    page = '<meta charset="shift_jis"><a href="漢">字</a>'
    rows = captures(spark, [("https://x.test/a", page, "text/html"), ("https://x.test/b", "<frameset><frame src='l.html'></frameset>", "text/html"), ("https://x.test/c", "<a href=x>", "image/png"), ("https://x.test/d", None, "text/html")])
    coded = rows.toPandas().assign(body=lambda t: [b if b is None else b.encode("shift_jis") for b in t["body"]])
    as_bytes = spark.createDataFrame(coded.to_dict("records"), rows.drop("body").withColumn("body", F.lit(None).cast("binary")).schema)
    text, held = (links.with_links(r).orderBy("k") for r in (rows, as_bytes.select(rows.columns)))
    assert [r["links"] for r in held.collect()] == [r["links"] for r in text.collect()] and held.schema["body"].dataType.simpleString() == "binary"


def test_insertions(spark):
    page = "<html><head><title>t</title></head><body><p>x</p></body></html>"
    df = spark.createDataFrame([(page,), ("<p>bare",), ("<body><a id='foot'>f</a></body>",)], "h string")
    h = F.col("h")
    made = df.select(rewrite.add_favicon(h, F.lit('/i?a&"b')), rewrite.add_robots(h), rewrite.add_footer(h, F.lit('<a id="foot">z</a>'), "foot")).collect()
    assert made[0][0] == page.replace("<head>", '<head><link rel="icon" href="/i?a&amp;&quot;b">') and made[1][0] == '<link rel="icon" href="/i?a&amp;&quot;b"><p>bare'
    assert made[0][1] == page.replace("<head>", '<head><meta name="robots" content="none">')
    assert [r[2] for r in made] == [page.replace("</body>", '<a id="foot">z</a></body>'), "<p>bare", "<body><a id='foot'>f</a></body>"]


def test_pager_of_a_script(spark):
    pager = '<a class="facetwp-page active" data-page="1">1</a><a class="facetwp-page" data-page="3">3</a>'
    body = "<script>x();\nwindow.FWP_JSON = " + json.dumps({"preload_data": {"pager": pager}}) + ";\n</script>"
    rows = captures(spark, [("https://minimalistbaker.com/r?a=b&fwp_paged=2", body, "text/html"), ("https://other.com/r", body, "text/html"), ("https://minimalistbaker.com/r", "<script>window.FWP_JSON = {;</script>", "text/html")])
    found = [[(k["relative_url"], k["type_title"], k["title"], k["target_url"]) for k in r["links"]] for r in links.with_links(rows, rules=(links.paginator,)).collect()]
    assert found == [[("/r?a=b", "Paginator Reference", "1", "https://minimalistbaker.com/r?a=b"), ("/r?a=b&fwp_paged=3", "Paginator Reference", "3", "https://minimalistbaker.com/r?a=b&fwp_paged=3")], [], []]


def test_tags_by_name_and_attribute(spark):
    df = spark.createDataFrame([(1, '<p class="a">x<A Class="nav b" href=u>y</A><p>z'), (2, None), (3, "")], "id int, html string")

    def found(**how):
        return [(r["id"], r["pos"], r["tag"], r["text"]) for r in links.find_tags(df, "html", **how).collect()]

    assert found() == [(1, 0, "p", "x"), (1, 1, "a", "y"), (1, 2, "p", "z")]
    assert found(tag="p", attribute="class") == [(1, 0, "p", "x")]
    assert found(attribute="class", matches=r"\bnav\b") == [(1, 1, "a", "y")] and found(attribute="href", equals="v") == []


def test_table_functions_of_a_session(spark):
    rows = [("https://x.test/a", "html", '<a href="b">t</a><p class=c>u'), ("https://x.test/", "css", "a{b:url(i.png)}"), ("https://x.test/f", "html", "<frameset><frame src='l.html'></frameset>"), (None, None, "<a href=x>"), ("https://x.test/n", "html", None)]
    table = spark.createDataFrame(rows, "url string, kind string, body string")
    sql.register(spark)
    found = spark.sql("SELECT l.* FROM {t} t, LATERAL document_links(t.url, t.kind, t.body) l", t=table)
    assert sorted((r["pos"], r["type_title"], r["title"], r["target_url"]) for r in found.collect()) == [(0, "CSS URL Reference", None, "https://x.test/i.png"), (0, "Link", "t", "https://x.test/b"), (0, "Unknown", None, "https://x.test/l.html")]
    other = spark.newSession()
    sql.register(other, rules=(lambda url, kind, body, found: found * 2,))
    again = other.createDataFrame(rows, table.schema)
    assert other.sql("SELECT * FROM {t} t, LATERAL document_links(t.url, t.kind, t.body) l", t=again).count() == 6 and found.count() == 3
    tags = spark.sql("SELECT t.pos, t.tag, t.attributes, t.text FROM {t} d, LATERAL document_tags(d.body) t WHERE d.url = 'https://x.test/a'", t=table).collect()
    assert [tuple(r) for r in tags] == [(0, "a", {"href": "b"}, "t"), (1, "p", {"class": "c"}, "u")]


def test_batches_are_taken_apart_in_parts_of_bounded_size():
    import pyarrow as pa

    bodies = ["x" * 1000] * 50 + [None, "", "y" * 900_000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(bodies))), pa.array(bodies)], ["k", "body"])
    parts = list(links.slices(batch, "body", most=10_000))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(len(bodies)))
    assert all(p.num_rows == 1 or sum(len(b or "") for b in p.column("body").to_pylist()) <= 10_000 for p in parts)
    assert 6 <= len(parts) <= 9 and list(links.slices(batch.slice(0, 0), "body")) == []

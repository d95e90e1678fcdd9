"""Links of one document, and where each stands in it.

A small helper for the Arrow steps of :mod:`..operators.links` and
:mod:`..operators.rewrite`: one scan over a document's tags, no tree.  A link
stands in a holder, a span of the document: an attribute's value (whose
``quote`` is its mark, or empty if it has none) or a stretch of raw text (no
``quote``).  Within the holder's decoded text its URL takes the characters
[at, until), written as ``form`` says: ``html`` and ``text`` as they are,
``css`` without what ends a ``url()``, ``json`` as in a quoted string.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import escape, unescape
from typing import NamedTuple
from urllib.parse import urljoin
from xml.etree import ElementTree

#: URLs that likely name an embedded resource: fixed value.
PROBABLY_EMBEDDED = r"(?i)\.(gif|jpe?g|png|svg|js|css)(?:\?[^/?]*)?$"
#: Elements without content, and those whose content has no tags: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
_EMBEDDED, _ABSOLUTE = re.compile(PROBABLY_EMBEDDED), re.compile(r"(?i)https?://[^\n\r]+\Z")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CSS = re.compile(r"""
    (?P<skip>/\*.*?(?:\*/|\Z)|<!--|-->)
    | (?P<string>"(?:[^"\\\n]|\\.)*+(?:"|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|\Z))
    | (?P<word>[@\#]?(?:[\w-]|[^\x00-\x7f]|\\[^\n])+)
    | (?P<mark>[(){}\[\]:;])""", re.S | re.X)
_CSS_URL = re.compile(r"""\([ \t\r\n\f]*((?:[^\s"'()\\]|\\(?:[0-9a-fA-F]{1,6}[ \t\r\n\f]?|[^\n0-9a-fA-F]))*)[ \t\r\n\f]*(?:\)|\Z)""")
_CSS_QUOTED_URL = re.compile(r"""\((?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')\)""", re.S)
_CSS_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})(?:\r\n|[ \t\r\n\f])?|(\r\n|[\r\n\f])|(.))", re.S)
_INTEGRITY = re.compile(r"\s+integrity\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_QUOTED_PAGE = re.compile(r"""['"]([^'"]+\.s?html?)['"]""", re.I)
_ASSIGNED = re.compile(r"""\.(?:href|location) *= *(?:"([^'"]*)"|'([^'"]*)') *;?\Z""", re.I)
_OPENS_URL = re.compile(r"""["'](?=(?:https?:)?(?:\\?/){2})""", re.I)
_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')
_XML_TEXT = re.compile(r"\s*<!\[CDATA\[(.*?)\]\]>|([^<]*)", re.S)


class Link(NamedTuple):
    relative_url: str
    type_title: str
    title: str | None
    embedded: bool
    tag: str
    attr: str
    target_url: str | None
    start: int | None
    end: int | None
    quote: str | None
    at: int | None
    until: int | None
    form: str | None
    cut_from: int | None = None  # what goes from the document if the link is rewritten
    cut_until: int | None = None


class Holder(NamedTuple):
    """A span of the document and its decoded text."""

    start: int
    end: int
    quote: str | None
    text: str


class Element(NamedTuple):
    tag: str
    attrs: dict[str, Holder]
    text: Holder | None  # what precedes the first child; decoded, but for script and style
    start: int
    end: int  # of the tag itself


def attributes(html: str, start: int, end: int) -> dict[str, Holder]:
    found: dict[str, Holder] = {}
    for m in _ATTRIBUTE.finditer(html, start, end):
        group = m.lastindex or 1
        name = m[1].lower()
        if name in found:
            continue
        if group == 1:
            found[name] = Holder(m.end(), m.end(), None, "")
        else:
            raw = m[group]
            found[name] = Holder(*m.span(group), ("", "", '"', "'", "")[group], unescape(raw) if "&" in raw else raw)
    return found


def elements(html: str) -> Iterator[Element]:
    """The elements in document order, by their start tags."""
    at, n = 0, len(html)
    held: tuple | None = None  # the element whose leading text goes on, and the text's parts
    while True:
        m = _TAG.search(html, at)
        if held is not None:
            held[3].append(html[at : m.start() if m else n])
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None and m[1] is None:
            continue  # a comment; the text goes on
        if held is not None:
            yield _closed(held)
            held = None
        if tag is None:
            continue
        tag = tag.lower()
        attrs = attributes(html, *m.span(3)) if m[3] else {}
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            end = close.start() if close else n
            raw = html[at:end]
            yield Element(tag, attrs, Holder(at, end, None, raw) if raw else None, m.start(), m.end())
            at = end
        elif tag in VOID or m[3].endswith("/"):
            yield Element(tag, attrs, None, m.start(), m.end())
        else:
            held = (tag, attrs, (m.start(), m.end()), [])
    if held is not None:
        yield _closed(held)


def _closed(held: tuple) -> Element:
    tag, attrs, (start, end), parts = held
    text = "".join(parts)
    return Element(tag, attrs, Holder(end, end + len(text), None, unescape(text)) if text else None, start, end)


def _trimmed(holder: Holder) -> tuple[str, int, int]:
    """The text without white space around it, and its span."""
    left = len(holder.text) - len(holder.text.lstrip())
    bare = holder.text.strip()
    return bare, left, left + len(bare)


def _css_text(raw: str) -> str:
    """A string's or URL's text: escapes resolved, line continuations out."""
    def plain(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return m[3] or ""

    return _CSS_ESCAPE.sub(plain, raw) if "\\" in raw else raw


def css_spans(css: str, declarations: bool = False) -> Iterator[tuple[str, str, int, int]]:
    """URL, kind and span of ``url(...)`` in the blocks of rules and of the strings of ``@import`` rules.

    Tokens decide: what stands in strings and comments is none, and within a
    rule's block only its own level counts, neither nested blocks nor the
    arguments of functions.  A quoted ``url()`` counts if it holds its string
    alone.  With ``declarations`` the text is a style attribute, and the values
    of its declarations count.
    """
    open_: list[str] = []  # what closes the brackets that are open
    rule: str | None = None  # the first word of the statement, once there is one
    value = False  # within a declaration's value
    at, level = 0, 0 if declarations else 1
    while m := _CSS.search(css, at):
        at, kind, text = m.end(), m.lastgroup, m.group()
        if kind == "skip":
            continue
        if kind == "word":
            rule = rule or text
            if text.lower() == "url" and css.startswith("(", at):
                counts = len(open_) == level and (value if declarations else open_ == ["}"])
                quoted, bare = _CSS_QUOTED_URL.match(css, at), None
                if quoted:
                    found, at = quoted, quoted.end()
                elif css[at + 1 :].lstrip(" \t\r\n\f")[:1] in ('"', "'"):
                    continue  # a function with more than a string
                else:
                    found = bare = _CSS_URL.match(css, at)
                    at = bare.end() if bare else css.find(")", at) + 1 or len(css)
                if counts and found:
                    yield _css_text(found[found.lastindex]), "CSS URL Reference", *found.span(found.lastindex)
            continue
        if kind == "string":
            rule = rule or text
            if not declarations and not open_ and rule == "@import" and len(text) > 1 and text[-1] == text[0]:
                yield _css_text(text[1:-1]), "CSS @import", m.start() + 1, m.end() - 1
        elif text in "([{":
            rule = rule or text
            open_.append({"(": ")", "[": "]", "{": "}"}[text])
        elif open_ and text == open_[-1]:
            open_.pop()
            if not open_ and text == "}" and not declarations:
                rule = None
        elif not open_ and text == ":":
            value = value or (rule is not None and not rule.startswith("@"))
        elif not open_ and text == ";":
            # A rule without a block ends here, as a declaration does.
            if declarations or (rule or "").startswith("@"):
                rule, value = None, False


def srcset_spans(srcset: str) -> Iterator[tuple[str, int, int]]:
    """URL and span of each candidate; commas end a URL, but for ``data:`` URLs."""
    at, n = 0, len(srcset)
    while at < n:
        if srcset[at] in " ,":
            at += 1
            continue
        stops = " " if srcset.startswith("data:", at) else " ,"
        end = next((k for k in range(at, n) if srcset[k] in stops), n)
        yield srcset[at:end], at, end
        comma = srcset.find(",", end)
        at = n if comma < 0 else comma + 1


def script_spans(script: str) -> Iterator[tuple[str, int, int]]:
    """URL and span of the quoted strings that begin as an absolute URL does."""
    at = 0
    while m := _OPENS_URL.search(script, at):
        end = script.find(m.group(), m.end())
        if end < 0:
            at = m.end()
            continue
        inner = script[m.end() : end]
        rest = re.sub(r"^(?:https?:)?(?:\\?/){2}", "", inner, flags=re.I)
        bare = inner[:1] in "\\/"
        if rest.startswith("/") or (bare and not rest):
            at = m.end()
            continue
        at = end + 1
        try:
            yield json.loads(f'"{inner}"', strict=False), m.end(), end
        except ValueError:
            continue


def _link(holder: Holder, span: tuple[int, int], form: str, url: str, kind: str, title: str | None, embedded: bool, tag: str, attr: str) -> Link:
    return Link(url, kind, title, embedded, tag, attr, None, holder.start, holder.end, holder.quote, *span, form)


def _with_cut(link: Link, e: Element, html: str) -> Link:
    """The link with its tag's ``integrity`` attribute as what goes when it is rewritten."""
    if "integrity" not in e.attrs:
        return link
    m = _INTEGRITY.search(html, e.start, e.end)
    return link._replace(cut_from=m.start(), cut_until=m.end()) if m else link


def _value(e: Element, name: str) -> str | None:
    holder = e.attrs.get(name)
    return None if holder is None else holder.text


def _href_kind(e: Element, href: str) -> tuple[str, bool]:
    """Type and whether it is embedded."""
    if e.tag == "a":
        return "Link", False
    if e.tag != "link":
        return f"Unknown Href ({e.tag})", False
    rel, kind = _value(e, "rel"), _value(e, "type")
    names, path = rel or "", re.match(r"[^?#;]*", href)[0]
    if "stylesheet" in names or kind == "text/css" or path.endswith(".css"):
        return "Stylesheet", True
    if "icon" in names or path.endswith((".ico", ".png")):
        return "Icon", True
    if "preload" in names:
        return "Preload", True
    return (f"Unknown Href ({e.tag})" if rel is None else f"Unknown Link (rel={rel})"), False


def html_links(html: str) -> list[Link]:
    """The links by rule, then by place: style tags, style attributes, backgrounds, source srcset, src, image srcset, href, onclick, script strings, other absolute URLs."""
    rules: list[list[Link]] = [[] for _ in range(10)]
    for e in elements(html):
        tag, attrs = e.tag, e.attrs
        if tag == "style" and e.text:
            rules[0] += [_link(e.text, (a, b), "css", u, kind, None, True, tag, "string") for u, kind, a, b in css_spans(e.text.text)]
        if tag == "script" and e.text and (_value(e, "type") or "text/javascript").lower() == "text/javascript":
            rules[8] += [_link(e.text, (a, b), "json", u, "Script Reference", None, bool(_EMBEDDED.search(u)), tag, "string") for u, a, b in script_spans(e.text.text)]
        for name, holder in attrs.items():
            if name == "style":
                rules[1] += [_link(holder, (a, b), "css", u, kind, None, True, tag, name) for u, kind, a, b in css_spans(holder.text, declarations=True)]
            if name == "background":
                url, a, b = _trimmed(holder)
                rules[2].append(_link(holder, (a, b), "html", url, "Background Image", None, True, tag, name))
            elif name == "srcset" and tag in ("source", "img"):
                kind, title = ("Image Source", None) if tag == "source" else ("Image", attrs.get("alt") or attrs.get("title"))
                found = [_link(holder, (a, b), "html", u, kind, title and title.text, True, tag, name) for u, a, b in srcset_spans(holder.text)]
                rules[3 if tag == "source" else 5] += found
            elif name == "src":
                url, a, b = _trimmed(holder)
                button = tag == "input" and _value(e, "type") == "image"
                kind = {"img": "Image", "iframe": "IFrame", "frame": "Frame"}.get(tag) or ("Form Image" if button else f"Unknown Embedded ({tag})")
                title = attrs.get("name") if tag in ("iframe", "frame") else (attrs.get("alt") or attrs.get("title")) if tag == "img" or button else None
                link = _link(holder, (a, b), "html", url, kind, title and title.text, True, tag, name)
                rules[4].append(_with_cut(link, e, html) if tag == "script" else link)
            elif name == "href":
                url, a, b = _trimmed(holder)
                kind, embedded = _href_kind(e, url)
                link = _link(holder, (a, b), "html", url, kind, e.text.text if tag == "a" and e.text else None, embedded, tag, name)
                rules[6].append(_with_cut(link, e, html) if tag == "link" else link)
            elif name == "onclick" and (m := _ASSIGNED.search(holder.text)):
                rules[7].append(_link(holder, m.span(m.lastindex), "json", m[m.lastindex], "Clickable", _value(e, "value"), False, tag, name))
            else:
                url, a, b = _trimmed(holder)
                if _ABSOLUTE.match(url):
                    rules[9].append(_link(holder, (a, b), "html", url, "Attribute Reference", None, bool(_EMBEDDED.search(url)), tag, name))
    return [k for rule in rules for k in rule]


def _whole(text: str) -> Holder:
    return Holder(0, len(text), None, text)


def frameset_links(html: str) -> list[Link]:
    """Quoted names of HTML pages, for documents of frames."""
    return [_link(_whole(html), m.span(1), "html", m[1], "Unknown", None, False, "html", "quoted") for m in _QUOTED_PAGE.finditer(html)]


def css_links(css: str) -> list[Link]:
    return [_link(_whole(css), (a, b), "css", u, kind, None, True, "css", "css") for u, kind, a, b in css_spans(css)]


def json_links(text: str) -> list[Link]:
    """Keys, values and items that are absolute URLs, in their order; none for invalid JSON or a lone string."""
    try:
        if not isinstance(json.loads(text), dict | list):
            return []
    except (ValueError, RecursionError):
        return []
    found = ((json.loads(m.group(), strict=False), m) for m in _JSON_STRING.finditer(text) if "http" in m.group().lower())
    return [_link(_whole(text), (m.start() + 1, m.end() - 1), "json", u, "JSON URL Reference", None, False, "json", "value") for u, m in found if _ABSOLUTE.match(u)]


def xml_links(text: str) -> list[Link]:
    """The text (RSS) and href (Atom) of every link element; none for malformed XML."""
    try:
        ElementTree.fromstring(text.encode())
    except ElementTree.ParseError:
        return []
    found = []
    for m in _TAG.finditer(text):
        if m[2] is None or m[2].rpartition(":")[2] != "link":
            continue
        inner = None if m[3].endswith("/") else _XML_TEXT.match(text, m.end())
        if inner and inner[inner.lastindex or 0].strip():
            group = inner.lastindex
            holder = Holder(*inner.span(group), None if group == 1 else "", inner[group] if group == 1 else unescape(inner[group]))
            url, a, b = _trimmed(holder)
            found.append(_link(holder._replace(quote=None if group == 1 else "<"), (a, b), "text", url, "Link", None, False, "link", "string"))
        if href := attributes(text, *m.span(3)).get("href"):
            url, a, b = _trimmed(href)
            found.append(_link(href, (a, b), "html", url, "Link", None, False, "link", "href"))
    return found


KINDS = {"frames": frameset_links, "html": html_links, "css": css_links, "json": json_links, "xml": xml_links}


def target(base: str | None, relative: str) -> str | None:
    """The URL that a link of page ``base`` leads to; as it is where it can't be resolved."""
    if base is None:
        return None
    try:
        return urljoin(base, relative)
    except ValueError:
        return relative


def written(url: str, form: str) -> str:
    """A URL as it stands in the decoded text of its holder."""
    if form == "css":
        return re.sub(r"""[\s"'()]""", lambda m: f"%{ord(m.group()):02X}", url)
    return json.dumps(url)[1:-1].replace("'", "\\u0027").replace("</", "<\\/") if form == "json" else url


def encoded(text: str, quote: str | None) -> str:
    """A holder's text as it stands in the document."""
    if quote is None:
        return text
    text = escape(text, quote=False)
    if quote == "<":
        return text
    mark = quote or '"'
    text = text.replace(mark, "&quot;" if mark == '"' else "&#39;")
    return text if quote else f'"{text}"'


def spliced(document: str, holders: dict[tuple, list[tuple[int, int, str]]], cuts: list[tuple[int, int]] = ()) -> str:
    """The document with new texts at spans of its holders, and without the cuts.

    ``holders`` maps (start, end, quote) to (at, until, text) of the decoded
    text.  Nothing outside those spans changes.
    """
    edits = [(a, b, "") for a, b in cuts]
    for (start, end, quote), parts in holders.items():
        raw = document[start:end]
        text = raw if quote is None or "&" not in raw else unescape(raw)
        done, last = [], 0
        for at, until, new in sorted(parts):
            if at >= last:
                done += [text[last:at], new]
                last = until
        edits.append((start, end, encoded("".join([*done, text[last:]]), quote)))
    out, last = [], 0
    for start, end, new in sorted(edits):
        if start >= last:
            out += [document[last:start], new]
            last = end
    return "".join([*out, document[last:]])

"""Page text, metadata and links from HTML, by an Arrow UDF over a lenient tree builder.

The primary region is the first main, else the first article, else the body.
Furniture and unseen elements leave the tree for good where the region is a
main or an article, so their links go too; the body's own text is taken from
what remains without touching the links.  Text nodes are joined without a
separator, then white space is collapsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .batches import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style svg noscript template".split())
FURNITURE = frozenset("nav header footer aside".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead")}
SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SKIPPED = ("mailto:", "javascript:", "tel:")

LINK = "struct<to_url:string,anchor:string,is_internal:boolean>"
EXTRACTED = f"body_text string, title string, meta_description string, canonical_url string, last_modified string, published_date string, links array<{LINK}>"


def collapse(text: str) -> str:
    return SPACE.sub(" ", text).strip(" ")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def first(self, test):
        return next((n for n in self.walk() if test(n)), None)

    def text(self, without=lambda n: False) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n is self or not without(n):
                stack.extend(reversed(n.children))
        return "".join(out)

    def drop(self, test) -> None:
        for n in list(self.walk()):
            n.children = [c for c in n.children if isinstance(c, str) or not test(c)]


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body") and (own := self.root.first(lambda n: n.tag == tag)) is not None:
            for k, v in attrs:
                own.attrs.setdefault(k, v or "")
            return
        if tag in ENDS_P:
            self._close("p", stops=("button", "td", "th", "table"))
        for own in ENDS_OWN.get(tag, ()):
            self._close(own, stops=("ul", "ol", "table", "dl", "select"))
        if tag == "body" and self.at.tag == "head":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.tag not in ("html", "head", "body"):
            svg = self.at
            while svg is not None and svg.tag not in ("svg", "math"):
                svg = svg.parent
            if svg is not None:
                self.at = self.at.parent

    def _close(self, tag, stops=()):
        n = self.at
        while n is not None and n.tag != tag:
            if n.tag in stops or n.parent is None:
                return
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_endtag(self, tag):
        if tag not in ("html", "body"):
            self._close(tag)

    def handle_data(self, data):
        self.at.children.append(data)

    def unknown_decl(self, data):
        pass


def parse(page: str) -> Node:
    b = Builder()
    b.feed(page)
    b.close()
    # Parents are for building only.  Without them a tree goes with its last reference, not when the collector comes by.
    for n in b.root.walk():
        n.parent = None
    return b.root


class _Firsts:
    """The first element of each kind that extraction asks for, found in one walk."""

    def __init__(self, root: Node):
        self.by_tag: dict[str, Node] = {}
        self.meta: dict[tuple[str, str], Node] = {}
        self.canonical = self.dated = self.base = None
        for n in root.walk():
            self.by_tag.setdefault(n.tag, n)
            if n.tag == "meta":
                for key in ("property", "name"):
                    if key in n.attrs:
                        self.meta.setdefault((key, n.attrs[key]), n)
            elif n.tag == "link" and self.canonical is None and n.attrs.get("rel") == "canonical":
                self.canonical = n
            elif n.tag == "time" and self.dated is None and "datetime" in n.attrs:
                self.dated = n
            elif n.tag == "base" and self.base is None and n.attrs.get("href"):
                self.base = n


def _content(n: Node | None) -> str:
    """An element's content attribute, else its datetime, else its text."""
    return "" if n is None else n.attrs.get("content") or n.attrs.get("datetime") or n.text().strip()


def extract(page: str, url: str) -> tuple:
    root = parse(page or "")
    found = _Firsts(root)
    text_of = lambda tag: "" if tag not in found.by_tag else found.by_tag[tag].text().strip()
    meta = lambda key, value: _content(found.meta.get((key, value)))
    title = text_of("title") or text_of("h1")
    modified = meta("property", "article:modified_time") or meta("name", "last-modified")
    published = meta("property", "article:published_time") or _content(found.dated)
    description = meta("name", "description")

    unseen = lambda n: n.tag in UNSEEN or n.tag in FURNITURE or n.attrs.get("aria-hidden") == "true"
    region = found.by_tag.get("main") or found.by_tag.get("article")
    if region is not None:
        region.drop(unseen)
        body = region.text()
    else:
        # Without a body element all that isn't the head's stands for it.
        body = found.by_tag.get("body", root).text(lambda n: unseen(n) or n.tag in ("head", "title"))

    base, links, seen = url or "", [], set()
    try:
        if found.base is not None:
            base = urljoin(base, found.base.attrs["href"])
        own_host = urlsplit(base).netloc
    except ValueError:
        own_host = ""
    for a in root.walk():
        href = a.attrs.get("href") if a.tag == "a" else None
        if not href or href.startswith(SKIPPED):
            continue
        try:
            to = urldefrag(urljoin(base, href)).url
            host = urlsplit(to).netloc
        except ValueError:
            continue
        if to not in seen:
            seen.add(to)
            links.append({"to_url": to, "anchor": collapse(a.text()), "is_internal": host == own_host})
    canonical = "" if found.canonical is None else found.canonical.attrs.get("href", "").strip()
    return collapse(body), title, description.strip(), canonical, modified.strip(), published.strip(), links


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
#: Elements whose content holds no tags.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title")}


def _tags(page: str):
    """``(name, attributes)`` of start tags outside of comments and raw text; what isn't closed ends the scan, so it takes linear time."""
    at = 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            if (end := page.find("-->", at + 4)) < 0:
                return
            at = end + 3
            continue
        m = _TAG.match(page, at)
        if m is None:
            at += 1
            continue
        end = m.end()
        while (stop := _STOP.search(page, end)) is not None and stop[0] != ">":
            end = page.find(stop[0], stop.end()) + 1
            if not end:
                return
        if stop is None:
            return
        name, at = m[2].lower(), stop.end()
        if not m[1]:
            yield name, page[m.end() : stop.start()]
            if name in _RAW:
                close = _RAW[name].search(page, at)
                if close is None:
                    return
                at = close.start()


def page_targets(page: str, url: str) -> list[str]:
    """Where a page links to, each once: the ``to_url`` of ``extract``'s links, by one scan of its tags and no tree."""
    base, hrefs = None, []
    for name, attributes in _tags(page):
        if name not in ("a", "base"):
            continue
        # The first of several counts.
        href = unescape(next((m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() == "href"), ""))
        if name == "base":
            base = base or href
        elif href and not href.startswith(SKIPPED):
            hrefs.append(href)
    try:
        root = urljoin(url, base) if base else url
        urlsplit(root)
    except ValueError:
        root = url
    out = {}
    for href in hrefs:
        try:
            out[urldefrag(urljoin(root, href)).url] = None
        except ValueError:
            continue
    return list(out)


def linked_urls(html: Column, url: Column) -> Column:
    """An array of ``page_targets``; null HTML counts as empty."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, urls in pieces(batches):
            yield pa.array([page_targets(p, u) for p, u in zip(pages.to_pylist(), urls.to_pylist())], pa.list_(pa.string()))

    return run(F.coalesce(html, F.lit("")), F.coalesce(url, F.lit("")))


_LINK = pa.struct([("to_url", pa.string()), ("anchor", pa.string()), ("is_internal", pa.bool_())])
_EXTRACTED = pa.struct([*((n, pa.string()) for n in ("body_text", "title", "meta_description", "canonical_url", "last_modified", "published_date")), ("links", pa.list_(_LINK))])


def _rows(pages: pa.Array, urls: pa.Array) -> pa.Array:
    columns = list(zip(*(extract(p, u) for p, u in zip(pages.to_pylist(), urls.to_pylist())))) or [()] * len(_EXTRACTED)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EXTRACTED)], fields=list(_EXTRACTED))


def extracted(html: Column, url: Column) -> Column:
    """A struct of the page's text, metadata and links; null HTML counts as empty."""

    # The return type's text is parsed by the session, so the function is made when one is there.
    @F.arrow_udf(EXTRACTED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, urls in pieces(batches):
            yield _rows(pages, urls)

    return run(F.coalesce(html, F.lit("")), F.coalesce(url, F.lit("")))

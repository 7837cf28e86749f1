"""Operator 1: main-text extraction by maximum-scoring subsequence.

A page becomes a sequence of tags and words.  A word scores positive; it loses
where it stands in a link, beside the page's own content element, or in an
element with a mark of furniture, and gains within an element with a mark of
content; every tag scores negative.  A mark is an element's name or a word of
its class, id or role.  One linear scan finds the contiguous region of largest
total, and its whole blocks, without what marks call furniture, are the text.

All weights are log-odds of word counts inside and outside the content of
labelled pages, those whose markup names one content element.  ``PRIOR`` says
what a mark is worth before any page was seen, as ``PRIOR_WORDS`` words would;
pages that use it otherwise outvote it.

Defined results: a null or empty page, or one without a word of positive
score, has an empty text.  Unclosed elements end with their parent; a lone
"<" is text.  Elements with the attribute hidden, aria-hidden or a style that
hides them are left out.  Furniture inside a content element scores zero, so
it parts no text.  Among equally good regions the first, and the longest from
there, is taken.  White space is Unicode's.  Rows that repeat a page_id keep a
row each; a very long page is scanned whole, alone in its chunk; other columns
are left out; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, chunks

#: Labelled pages that a fit reads at most: those of the smallest hashes of their id.
MAX_LABELLED = 2_000

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|([^<]++|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_STYLE_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is text up to their own closing tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of these ends where another of its kind, or their parent, begins or ends.
_ENDS = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"},
}
CONTENT = frozenset(("article", "main"))
#: Elements whose names tell what they hold, and those whose class, id and role are read.
NAMED = frozenset("article main nav aside footer header form dialog menu head".split())
MARKED = NAMED | frozenset("div section ul ol dl table span figure center fieldset details td tr".split())
#: What marks are worth before any page is seen: log-odds of content.
PRIOR = {"<article>": 3.0, "<main>": 3.0, "<header>": -2.0, "<head>": -6.0}
PRIOR |= dict.fromkeys("<nav> <aside> <footer> <form> <dialog> <menu>".split(), -6.0)
PRIOR |= dict.fromkeys("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split(), -6.0)
PRIOR |= dict.fromkeys("ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent popup modal newsletter subscribe signup sidebar nav navbar menu breadcrumb breadcrumbs comment comments reply replies social share sharing related recommended pagination pager login widget".split(), -6.0)
PRIOR |= dict.fromkeys("header footer masthead notice notices copyright legal disclaimer rail".split(), -2.5)
READERS = frozenset("comment comments reply replies".split())
#: Words that only say how or where an element is laid out: a mark counts beside these, but not as part of a phrase.
LAYOUT = frozenset("list area section box slot wrapper wrap container inner outer block bar item items links link buttons button posts post articles panel top bottom left right side main page site global primary secondary first last row col column group holder unit text title form notice banner widget nav".split())
#: Words that a prior counts as.
PRIOR_WORDS = 12.0

#: Weights where no labelled page is given; a mark that is not named weighs nothing.
DEFAULT = {"word": 1.0, "link": -1.5, "beside": -5.0, "tag": -0.1, "tag:a": -0.4, "tag:li": -0.2} | {f"mark:{k}": v for k, v in PRIOR.items()}
_WORDS = re.compile(r"[a-z]+")


class _Element:
    """An open element: where it stands, and what its markup says of it."""

    __slots__ = ("tag", "parent", "marks", "hidden", "holds", "content", "gain", "loss", "cut", "link")

    def __init__(self, tag, parent, marks, hidden):
        self.tag, self.parent, self.marks, self.hidden, self.holds = tag, parent, marks, hidden, False


@functools.lru_cache(4096)
def _phrase_marks(value: str) -> tuple[str, ...]:
    """Words of one class, id or role, unless it is a phrase: of several words all but one must be of layout."""
    words = _WORDS.findall(value)
    telling = [w for w in words if w not in LAYOUT]
    return tuple(telling or words) if len(telling) < 2 else ()


def _markup(tag: str, attrs: str) -> tuple[tuple[str, ...], bool]:
    """The marks of an element, and whether its attributes hide it."""
    marks = (f"<{tag}>",) if tag in NAMED else ()
    if not attrs:
        return marks, False
    # An attribute hides with any value or none; the value of another that reads so doesn't.
    hidden = "hidden" in re.split(r"[\s/]+", _ATTRIBUTE.sub(" ", attrs).lower())
    for name, x, y, z in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (x or y or z).lower()
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or _STYLE_HIDDEN.search(value) is not None
        elif name == "aria-hidden":
            hidden = hidden or value.strip() == "true"
        elif name in ("class", "id", "role") and tag in MARKED:
            for one in value.split():
                # A content element's own classes are the site's, but for those of readers' comments.
                marks += _phrase_marks(one) if tag not in CONTENT else tuple(w for w in _phrase_marks(one) if w in READERS)
    return marks, hidden


def _parse(page: str) -> tuple[list[tuple], list[_Element]]:
    """``(kind, text, block, element)`` in page order, and all elements, parents first."""
    root = _Element("", None, (), False)
    elements, stack = [root], [root]
    out: list[tuple] = []
    open_: set[str] = set()
    block, at, end = 0, 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:
            out.append(("word", page[at], block, stack[-1]))
            at += 1
            continue
        at = m.end()
        name, text = m[2], m[4]
        if text is not None:
            out.append(("word", text, block, stack[-1]))
            continue
        if name is None:
            continue
        name = name.lower()
        block += name in BLOCKS
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
                # A closing tag whose opening one is missing closes nothing beyond the content element.
                if stack[i].tag in CONTENT and name not in ("body", "html"):
                    break
            out.append(("tag:" + name, "", block, stack[-1]))
            continue
        # What this element ends, through unclosed inline elements.
        for i in range(len(stack) - 1, 0, -1):
            if name in _ENDS.get(stack[i].tag, ()):
                del stack[i:]
            elif stack[i].tag in BLOCKS or name not in BLOCKS:
                break
        out.append(("tag:" + name, "", block, stack[-1]))
        if name == "br":
            out.append(("word", " ", block, stack[-1]))
        if name in VOID:
            continue
        if name in RAW:
            # What it holds is dropped whole.
            stop = None if name in open_ else _closing(name).search(page, at)
            if stop is None:
                # None follows for any later one either, so it is looked for once.
                open_.add(name)
            if stop is not None:
                at = (page.find(">", stop.end()) + 1) or end
            elif name in ("script", "style"):
                at = end
            continue
        e = _Element(name, stack[-1], *_markup(name, m[3]))
        if name in CONTENT or name == "h1":
            for x in stack:
                x.holds = True
        elements.append(e)
        stack.append(e)
    return out, elements


@functools.cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I)


def _judge(elements: list[_Element], weights: dict[str, float]) -> bool:
    """What marks make of each element; whether the page has a content element.

    ``gain`` and ``loss`` are the best and the worst mark on the way from the root, a loss from before a content element
    begins not being one of what it holds; ``cut`` tells what is not content: hidden, or more lost than gained.
    Where the page's only content elements and headlines would be cut, the marks of what holds them don't count.
    """
    for trust in (True, False):
        seen = kept = False
        for e in elements:
            up = e.parent
            own = [weights.get(f"mark:{m}", 0.0) for m in e.marks] if trust or not e.holds else []
            gain, loss = max(own, default=0.0), min(own, default=0.0)
            if up is None:
                e.content, e.gain, e.loss, e.cut, e.link = False, 0.0, 0.0, False, False
                continue
            e.gain, e.loss = max(up.gain, gain), min(up.loss, loss)
            e.cut = up.cut or e.hidden or e.gain + e.loss <= -1.0
            e.content = not e.cut and (up.content or e.tag in CONTENT)
            e.link = up.link or e.tag == "a"
            if e.tag in CONTENT or e.tag == "h1":
                seen, kept = True, kept or not e.cut
        if kept or not seen:
            break
    return any(e.content for e in elements)


def counts(page: str) -> dict[str, tuple[int, int]]:
    """Of a page whose markup names one content element: units of each feature inside and outside it."""
    found, elements = _parse(page)
    named = [e for e in elements if e.tag in CONTENT]
    if len(named) != 1:
        return {}
    out: dict[str, list[int]] = {}
    for e in elements:
        up = e.parent
        e.content = e is named[0] or up is not None and up.content
        e.link = e.tag == "a" or up is not None and up.link
        e.cut = e.hidden or up is not None and up.cut
        e.marks = e.marks if up is None else tuple(dict.fromkeys(up.marks + e.marks))
    for kind, text, _, e in found:
        n = 1 if kind.startswith("tag") else len(text.split())
        if not n or e.cut:
            continue
        side = 0 if e.content else 1
        names = [kind] if kind.startswith("tag") else ["link" if e.link else "word", *(["beside"] if side else []), *(f"mark:{m}" for m in e.marks)]
        for name in names:
            out.setdefault(name, [0, 0])[side] += n
    return {k: (a, b) for k, (a, b) in out.items()}


def weights_from(totals: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of each feature, within the range that its kind may take; ``DEFAULT`` where nothing was counted."""
    out = dict(DEFAULT)
    words = [sum(totals.get(k, (0, 0))[i] for k in ("word", "link")) for i in (0, 1)]
    tags = [sum(v[i] for k, v in totals.items() if k.startswith("tag")) for i in (0, 1)]
    if not all(words):
        return out
    for k, (a, b) in totals.items():
        if k.startswith("tag"):
            # A tag weighs less than a word, so that a block of one word still pays for its markup.
            odds = math.log((a + 1) / (tags[0] + 1)) - math.log((b + 1) / (tags[1] + 1))
            out[k] = min(max(odds / 20 - 0.1, -0.4), -0.02)
            continue
        start = DEFAULT.get(k, 0.0)
        share = PRIOR_WORDS / (1 + math.exp(-start))
        odds = math.log((a + share) / (words[0] + PRIOR_WORDS)) - math.log((b + PRIOR_WORDS - share) / (words[1] + PRIOR_WORDS))
        low, high = {"word": (0.5, 3.0), "link": (-1.5, -0.2), "beside": (-6.0, -2.0)}.get(k, (-8.0, 4.0))
        out[k] = min(max(odds, low), high)
    return out


def fit_weights(pages: DataFrame, max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Weights from at most ``max_labelled`` pages of ``pages(page_id, html)``, those of the smallest hashes of their id."""
    ids = pages.filter(F.col("page_id").isNotNull()).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_labelled)

    def run(batches):
        for batch in batches:
            total: dict[str, list[int]] = {}
            for page in batch.column(0):
                for k, (a, b) in counts(page.as_py() or "").items():
                    own = total.setdefault(k, [0, 0])
                    own[0] += a
                    own[1] += b
            yield pa.RecordBatch.from_pydict({"feature": list(total), "a": [v[0] for v in total.values()], "b": [v[1] for v in total.values()]}, pa.schema([("feature", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))

    sample = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").select("html")
    # Pages can invent names; only those that hold words enough are worth a weight of their own.
    rows = sample.mapInArrow(run, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a + b >= 20").orderBy(F.desc(F.col("a") + F.col("b")), "feature").limit(400).collect()
    return weights_from({r.feature: (r.a, r.b) for r in rows})


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last index of the contiguous run of largest total; (0, -1) if no total is positive."""
    best, first, last = 0.0, 0, -1
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and start == first and last >= first:
            best, first, last = total, start, i
    return first, last


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    found, elements = _parse(page)
    named = _judge(elements, weights)
    scores = []
    for kind, text, _, e in found:
        # What lies cut within a content element neither joins nor parts what is around it.
        inner = e.cut and e.gain > 0
        if kind != "word":
            scores.append(0.0 if inner else weights.get(kind, weights["tag"]))
            continue
        n = len(text.split())
        one = weights["word"] + e.gain + e.loss + (weights["link"] if e.link else 0.0)
        if e.hidden or named and not e.content:
            # Beside the content a run costs once: a long advert parts no more than a short one.
            scores.append(0.0 if inner or not n else weights["beside"])
        else:
            scores.append(0.0 if inner else n * min(max(one, -4.0), 4.0))
    first, last = best_region(scores)
    if last < first:
        return ""
    # Whole blocks: the region grows to the ends of the blocks that it touches.
    shown = [not e.cut and (e.content or not named) for _, _, _, e in found]
    touched = [t[2] for t, ok in zip(found[first : last + 1], shown[first : last + 1]) if ok and t[1].strip()]
    low, high = (min(touched), max(touched)) if touched else (0, -1)
    parts: dict[int, list[str]] = {}
    for (_, text, block, _), ok in zip(found, shown):
        if text and ok and low <= block <= high:
            parts.setdefault(block, []).append(text)
    blocks = (" ".join(_html.unescape("".join(x)).split()) for x in parts.values())
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``(page_id, url, text)``: the main text of every page."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(h.as_py(), weights) for h in part.column(2)], pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return bounded(pages).select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def extract_report(pages: DataFrame) -> DataFrame:
    return extract(pages, fit_weights(pages)).withColumn("n_chars", F.length("text").cast("long"))

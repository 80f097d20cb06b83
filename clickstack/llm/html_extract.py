"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags. Words score positive, tags negative; the weights are log-odds
learned from labelled pages, per tag name and for words by whether they stand in a link. One linear scan
finds the contiguous run of tokens with the greatest sum. The run is widened to the element that holds it,
so that a short last paragraph is not lost to the tags around it, and its text is read block by block,
leaving out what lies inside elements that never hold content. A class or id that is a name of such parts
leaves its element out as well, but never an article or main element nor one beside which next to no text stands;
a name that is only a part of it lowers the scores, and leaves out lists of links.

Extraction is one pass over the pages without a shuffle; a task holds one page at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstack.llm.base import ship_by_value, text_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|xmp|noframes)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>"
    r"(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
#: Elements without end tags, elements inside a line, elements that never hold content, names
#: by which pages mark such parts and the main part, and the elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav header footer aside form button select option menu dialog object canvas audio video head".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
                  "consent cookie cookies disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation newsletter "
                  "notice notification pagination popup promo promotion related replies reply respond share sharing sidebar "
                  "signup skip social sponsor sponsored subscribe toolbar widget".split())
#: First parts after which a name says what the page has or is filed under, and not what the element is.
PREFIXES = frozenset("has with without no not hide category tag".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
MAIN = frozenset("article main".split())
MAIN_NAMES = frozenset("article content entry main maincontent post story body".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                   "nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
#: Marks by names: none, by a part of a name, by a whole name.
PART, WHOLE = 1, 2
#: An element with a whole name is kept when it has more than so many times the words of plain text beside it.
BESIDE = 10


class Element:
    __slots__ = ("name", "parent", "start", "end", "outside", "main", "doubt", "link", "words", "link_words", "clean", "beside")

    def __init__(self, name, parent, start, outside, main, doubt=0):
        self.name, self.parent, self.start, self.end = name, parent, start, None
        self.outside, self.main, self.doubt = outside, main, doubt
        self.link = name == "a" or parent is not None and parent.link
        self.words = self.link_words = self.clean = self.beside = 0


def _doubt(one: str, parts: list[str]) -> int:
    """How far a class or id marks its element as no content."""
    if one in NAMES or all(p in NAMES for p in parts):
        return WHOLE
    if parts[0] in PREFIXES or parts[0] in MAIN_NAMES and parts[-1] == "header":
        return 0
    return PART if parts[0] in NAMES or parts[-1] in NAMES else 0


def _marks(name: str, rest: str) -> tuple[bool, bool, int]:
    """Whether an element's name and attributes put it outside the content, or mark it as the main part, and how far
    its class and id speak against it."""
    outside, main, doubt = name in OUTSIDE, name in MAIN, 0
    own = main
    if rest:
        for key, value in ATTRIBUTE.findall(rest):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                for one in value.split():
                    parts = [p for p in re.split(r"[-_]+", one) if p] or [one]
                    doubt = max(doubt, _doubt(one, parts))
                    main |= one in MAIN_NAMES or len(parts) > 1 and parts[-1] in ("content", "body", "article") and parts[0] in MAIN_NAMES
            elif key == "role":
                outside |= value in ROLES
                main |= value in ("main", "article")
                own |= value in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                outside = True
            elif key == "style":
                outside |= "display:none" in value.replace(" ", "")
    if name in ("html", "body"):
        return False, main and not outside, 0
    return outside, main and not outside, min(doubt, PART) if own else doubt


def _settle(elements: list[Element], tokens: list[tuple[str, str, Element]]) -> None:
    """Judge marks by names, where the words of each element are known. A part of a name counts for nothing on an
    element with most of the page's words, and puts other elements outside that are mostly links. A whole name puts its
    element outside, unless next to nothing stands beside it (see ``BESIDE``): comments longer than the article are
    left out, a page that stands in a misnamed element is not."""
    for kind, value, element in tokens:
        if kind == "text" and not element.outside:
            n = len(value.split())
            element.words += n
            element.link_words += n * element.link
            element.clean += n * (not element.link)
    for e in reversed(elements[1:]):
        e.parent.words += e.words
        e.parent.link_words += e.link_words
        e.parent.clean += e.clean * (e.doubt != WHOLE)
    total = elements[0].words
    elements[0].beside = elements[0].clean
    for e in elements[1:]:
        e.beside = e.parent.beside
        if e.doubt == PART and 2 * e.words > total:
            e.doubt = 0
        elif e.doubt == WHOLE and BESIDE * e.beside < e.words:
            e.doubt = 0
            e.beside += e.clean
        if e.doubt == WHOLE or e.doubt == PART and not e.main and 2 * e.link_words > e.words:
            e.outside, e.main = True, False
        e.outside |= e.parent.outside
        e.doubt = max(e.doubt, e.parent.doubt)


def parse(html: str) -> list[tuple[str, str, Element]]:
    """(kind, value, element) per token; kind is ``word run``, ``open`` or ``close``. Broken nesting is mended:
    an end tag closes what is open inside its element, an end tag without an element is a tag alone."""
    root = Element("", None, 0, False, False)
    at, tokens, elements = root, [], [root]

    def leave(element):
        nonlocal at
        element.end = len(tokens)
        at = element.parent

    for m in TOKEN.finditer(html):
        text = m["text"]
        if text is not None:
            tokens.append(("text", text, at))
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            up = at
            while up is not root and up.name != name:
                up = up.parent
            if up is not root:
                while at is not up.parent:
                    if at is up:
                        tokens.append(("close", name, at))
                        leave(at)
                        break
                    leave(at)
            else:
                tokens.append(("close", name, at))
            continue
        if name in ENDS_P and at.name == "p":
            leave(at)
        elif name in ENDS_P:
            # A paragraph stays open beneath inline elements that were never closed.
            up = at
            while up.name in INLINE:
                up = up.parent
            if up.name == "p":
                while at is not up:
                    leave(at)
                leave(at)
        elif name in SIBLINGS:
            while at.name in SIBLINGS[name] or at.name == "p":
                leave(at)
        outside, main, doubt = _marks(name, m["rest"])
        if name in VOID or m["rest"].endswith("/") and name not in INLINE and name in ("svg", "path"):
            tokens.append(("open", name, at))
            continue
        new = Element(name, at, len(tokens), outside or at.outside, main, doubt)
        elements.append(new)
        tokens.append(("open", name, new))
        at = new
    while at is not root:
        leave(at)
    root.end = len(tokens)
    _settle(elements, tokens)
    return tokens


class Weights:
    """Score of a word, of a word in a link, and of each tag; tags score at most ``-FLOOR``."""

    FLOOR = 0.05

    def __init__(self, word: float, link: float, tags: dict[str, float], other: float):
        self.word, self.link, self.tags, self.other = word, link, tags, other


def fit_weights(pages: list[str]) -> Weights:
    """Log-odds of standing inside the content region, smoothed, from pages with the region between
    ``{{`` and ``}}``."""
    inside, outside = Counter(), Counter()
    for page in pages:
        before, rest = page.split("{{")
        content, after = rest.split("}}")
        a, b = len(before), len(before) + len(content)
        plain = before + content + after
        place = [m.start() for m in TOKEN.finditer(plain) if m["text"] is not None or m["name"] is not None]
        for (kind, value, element), pos in zip(parse(plain), place):
            seen = inside if a <= pos < b else outside
            if kind == "text":
                seen["link" if element.link else "word"] += len(value.split())
            else:
                seen[f"<{value}>"] += 1
    odds = lambda k: log((inside[k] + 0.5) / (outside[k] + 0.5))
    tags = {k[1:-1]: min(-Weights.FLOOR, odds(k) / 4 - 0.5) for k in {*inside, *outside} if k[0] == "<"}
    return Weights(max(Weights.FLOOR, odds("word")), max(Weights.FLOOR, odds("link") + 1), tags, -1.0)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the greatest sum, the first and shortest of equals; (0, 0) if none is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def _widened(tokens, a: int, b: int) -> tuple[int, int]:
    """The bounds of the element around the run: the nearest main element if there is one, else the nearest
    element that holds the whole run and is not a line or a paragraph."""
    up = tokens[a][2]
    while up.parent is not None and not (up.start <= a and up.end >= b):
        up = up.parent
    holder = up
    while up is not None:
        if up.main:
            return up.start, up.end
        up = up.parent
    while holder.parent is not None and (holder.name in INLINE or holder.name in ("p", "li", "ul", "ol", "h1", "h2", "h3", "td", "tr", "tbody", "table", "blockquote", "pre")):
        holder = holder.parent
    if holder.parent is None or holder.name in ("html", "body"):
        # No element parts the content from the rest: whole blocks that the run touches.
        while a > 0 and tokens[a][0] == "text" and tokens[a - 1][0] == "open" and tokens[a - 1][1] not in ("html", "body"):
            a -= 1
        return a, b
    return holder.start, holder.end


def main_text(html: str | None, weights: Weights) -> str:
    """The content region's text: white space inside a block is one space, blocks are joined by one."""
    tokens = parse(html or "")
    scores = []
    for kind, value, element in tokens:
        if kind == "text":
            n = 0 if element.outside else len(unescape(value).split())
            scores.append(n * (weights.link if element.link else weights.word) / (2 if element.doubt else 1))
        else:
            scores.append(weights.tags.get(value, weights.other))
    a, b = best_region(scores)
    if a == b:
        return ""
    a, b = _widened(tokens, a, b)
    out = []
    for kind, value, element in tokens[a:b]:
        if kind == "text":
            if not element.outside:
                out.append(unescape(value))
        elif value not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def extract_main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, one row per input row; ``n_chars`` counts code points.

    Null and empty pages, and pages without words, have the empty text. Very long pages are read whole. Of
    regions with equal scores the first is taken. Repeated rows are extracted alike; an empty table gives an
    empty result. Only id, url and html are read."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        text_of(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


ship_by_value(__name__)

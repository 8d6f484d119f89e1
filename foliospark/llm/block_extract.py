"""Operator 5, main text of HTML pages by two-pass block rules.

Markup is split into blocks at block-level tags.  Blocks inside navigation, page header or
footer, sidebar, form, script and similar elements, or in elements whose class, id or role names
such a part, are boilerplate whatever they say.  Names of layouts (has-, no-, with-, content-...-wrap)
are no such names, and a class or id does not drop an element with a main element, with articles that
hold as much good text as all that is left, or (but for names as ad or comments) with most of the
page's good text.  The rest is judged twice:

1. by itself: high link density is bad; long blocks with many stop words are good, with fewer
   near good; short blocks without links stay open;
2. open blocks take the label of the nearest decided neighbours on both sides: good when either
   nearest decided block in the same container is good, or when both sides agree; headings look
   forward.

Article and main elements are a prior, if they hold at least as much text that is good by itself
as the rest of the page: in them short blocks with a few links stay open, and open blocks are good
unless the nearest decided blocks of the elements on both sides are bad.  Blocks elsewhere, and all
blocks of a page whose good text is mostly elsewhere, are judged without it.

Character references are decoded, white space within a block becomes one space, blocks are
trimmed and joined by a line feed in page order.

Defined results: null or empty html, or no good block: empty text.  Each row is judged alone, so
repeated rows and null ids come back as they are.  Unclosed tags and cut-off pages are closed at
the end; nesting is tracked without recursion, so depth and length are unbounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# Stop words of the four languages, in order.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its my not of on or our she so that the their they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous "
    "als am auch auf aus bei bin das dass dem den der des die ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von war wie wir zu zum zur "
    "al como con de del el ella en entre era es esta este fue ha la las lo los más me mi muy no nos o para pero por que se sin sobre son su sus un una y ya".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROP_TAGS = frozenset("aside button datalist dialog fieldset footer form head iframe label legend menu nav noscript object option select svg textarea title".split())
RAW_TAGS = ("script", "style", "template", "textarea", "noscript", "iframe", "svg", "title")
SELF_CLOSING = frozenset("p li dd dt tr td th option".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP_NAMES = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts banner banners breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie cookies copyright disclaimer "
    "disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
# Of these, names that no wrapper of the main text bears, and what makes a compound one of a layout.
FIRM_NAMES = frozenset("ad ads adbox adsense advert advertisement advertising adverts captcha comment comments commentlist consent cookie cookies disqus gdpr popup replies reply respond".split())
LAYOUT_FIRST, LAYOUT_LAST, LAYOUT_CONTENT = frozenset("has no with without".split()), frozenset("wrap wrapper".split()), frozenset("article content main".split())
DROP_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
LONG, SHORT = 60, 25  # characters: longer is judged by stop words, shorter stays open
STOP_HIGH, STOP_LOW, LINKS = 0.30, 0.12, 0.35  # shares of stop words and of linked characters

# A quote delimits a value only where the value begins with it.
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)"
    r"((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*|(?=>|\Z)))?)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_UNQUOTED = re.compile(r"=\s*[^\s\"'=>]*/\Z")  # the slash belongs to a value
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW_TAGS}
_NAME = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Named:
    """An element that its class or id drops, unless it turns out to hold the main text."""

    serial: int
    up: Named | None  # the nearest such element around it
    firm: bool
    depth: int  # articles and main elements around it, without those of a dropping name
    main: bool = False
    lost: bool = True
    good: int = 0  # characters of good text, without what elements in it drop
    article: int | None = None  # those in articles of its own; None: there is no text in such


@dataclass(frozen=True, eq=False)
class _Place:
    """What an open element makes of the text in it."""

    dropped: bool
    inside: bool  # an article or main element
    container: int
    named: Named | None
    depth: int


_TOP = _Place(False, False, 0, None, 0)


@dataclass
class Block:
    text: str
    linked: int
    dropped: bool
    heading: bool
    inside: bool  # in an article or main element
    container: int
    label: str = "open"
    named: Named | None = None
    depth: int = 0


def _attributes(raw: str) -> dict[str, str]:
    if not raw or not _TELLING.search(raw):
        return {}
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _dropped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in DROP_TAGS or tag == "header" and not in_article:
        return True
    hidden = "hidden" in attributes and attributes["hidden"].lower() != "until-found" or attributes.get("aria-hidden", "").lower() == "true"
    return hidden or attributes.get("role", "").lower() in DROP_ROLES or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I) is not None


def _names(attributes: dict[str, str]) -> set[str]:
    """Words of class and id that drop an element."""
    found = set()
    for value in (attributes.get("class", ""), attributes.get("id", "")):
        for compound in value.split():
            parts = [p.lower() for p in _NAME.split(compound) if p]
            names = DROP_NAMES.intersection(parts)
            if names and not _layout(parts):
                found |= names
    return found


def _layout(parts: list[str]) -> bool:
    return parts[0] in LAYOUT_FIRST or parts[-1] in LAYOUT_LAST and not LAYOUT_CONTENT.isdisjoint(parts) and FIRM_NAMES.isdisjoint(parts)


class _Open:
    """The open elements, from the outside in."""

    def __init__(self):
        self.stack: list[tuple[str, _Place]] = []
        self.at: dict[str, list[int]] = {}  # where each tag is open
        self.blocks: list[int] = []  # where block-level elements are
        self.walls: list[int] = []  # where those are that a start tag of a list item or paragraph does not close

    def place(self) -> _Place:
        return self.stack[-1][1] if self.stack else _TOP

    def block_place(self) -> _Place:
        return self.stack[self.blocks[-1]][1] if self.blocks else _TOP

    def push(self, tag: str, place: _Place) -> None:
        k = len(self.stack)
        self.at.setdefault(tag, []).append(k)
        if tag in BLOCK_TAGS:
            self.blocks.append(k)
            if tag not in SELF_CLOSING:
                self.walls.append(k)
        self.stack.append((tag, place))

    def innermost(self, tag: str, bounds: list[int]) -> int | None:
        """Where the tag is open within the innermost one of bounds."""
        found = self.at.get(tag)
        return found[-1] if found and (not bounds or found[-1] >= bounds[-1]) else None

    def close(self, k: int) -> None:
        while len(self.stack) > k:
            tag, _ = self.stack.pop()
            self.at[tag].pop()
            for bounds in (self.blocks, self.walls):
                if bounds and bounds[-1] == len(self.stack):
                    bounds.pop()


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order.  What inline elements drop is left out of their block."""
    from html import unescape

    out: list[Block] = []
    parts: list[tuple[str, bool, _Place]] = []
    open_ = _Open()
    links = heading = serial = 0

    def emit(own: list[tuple[str, bool, _Place]], place: _Place) -> bool:
        text = " ".join(unescape("".join(p for p, _, _ in own)).split())
        if text:
            linked = sum(len(" ".join(unescape(p).split())) for p, a, _ in own if a)
            out.append(Block(text, linked, place.dropped, heading > 0, place.inside, place.container, named=place.named, depth=place.depth))
        return bool(text)

    def flush() -> None:
        nonlocal parts
        if parts:
            base = open_.block_place()
            fate = (base.dropped, base.named)
            own = [p for p in parts if (p[2].dropped, p[2].named) == fate]
            if not emit(own, base):
                for _, group in groupby((p for p in parts if (p[2].dropped, p[2].named) != fate), lambda p: (p[2].dropped, id(p[2].named))):
                    group = list(group)
                    emit(group, group[0][2])
            parts = []

    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        stop = m.start() if m else len(html)
        if stop > at:
            parts.append((html[at:stop], links > 0, open_.place()))
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            parts.append((m[0][9:].removesuffix("]]>"), links > 0, open_.place()))
        if not m[2]:
            continue
        closing, tag = m[1], m[2].lower()
        bare = not closing and m[3].endswith("/") and not _UNQUOTED.search(m[3])
        if not closing and tag in _RAW_END and not bare:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            if tag in BLOCK_TAGS:
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in VOID_TAGS or bare:
            continue
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = 0 if closing else 1
        if closing:
            k = open_.innermost(tag, [] if tag in BLOCK_TAGS else open_.blocks)  # an inline end tag closes no block
            if k is not None:
                open_.close(k)
            if tag in BLOCK_TAGS:
                links = 0
            continue
        attributes = _attributes(m[3])
        if tag not in BLOCK_TAGS and tag not in DROP_TAGS and not attributes:
            continue
        if tag in SELF_CLOSING:  # opening one closes an open one beside it
            k = open_.innermost(tag, open_.walls)
            if k is not None:
                open_.close(k)
        up = open_.place()
        drop = up.dropped or _dropped(tag, attributes, up.inside)
        names = _names(attributes) if attributes and not drop and tag not in ("html", "body") and not (up.inside and tag == "header") else ()
        serial += 1
        named, depth = up.named, up.depth
        if tag in ("article", "main"):
            depth += not names
            if named and tag == "main" and not drop:
                named.main = True
        elif names:
            named = Named(serial, named, not FIRM_NAMES.isdisjoint(names), depth)
        own = serial if tag in ("article", "main", "section", "div", "body", "td", "blockquote") else up.container
        open_.push(tag, _Place(drop, up.inside or tag in ("article", "main"), own, named, depth))
    flush()
    return out


def label(found: list[Block]) -> None:
    """Both passes; sets label to good or bad."""
    weak: list[Block] = []
    for b in found:
        if b.dropped:
            b.label = "bad"
            continue
        size = len(b.text)
        links = b.linked / size
        words = _LETTERS.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        if links > LINKS:
            b.label = "bad"
        elif size >= LONG and stops >= STOP_HIGH or size >= 2 * LONG and stops >= STOP_LOW:
            b.label = "good"
        elif size >= LONG and stops < STOP_LOW / 2 and links > 0 or size < SHORT and links > 0:
            weak.append(b)
    _drop_named(found)
    good = [0, 0]  # characters outside and inside article and main
    for b in found:
        if b.dropped:
            b.label = "bad"
        good[b.inside] += len(b.text) * (b.label == "good")
    prior = good[True] >= good[False]
    for b in weak:
        if b.dropped or not (prior and b.inside):
            b.label = "bad"
    _inherit(found, prior)


def _drop_named(found: list[Block]) -> None:
    """Drops the blocks of elements that a class or id drops and that do not hold the main text."""
    elements: dict[int, Named] = {}
    total = left = 0
    bare = True  # no text is left in article and main elements
    for b in found:
        if b.dropped:
            continue
        size = len(b.text) * (b.label == "good")
        total += size
        n = b.named
        if n is None:
            left, bare = left + size, bare and not b.inside
            continue
        n.good += size
        if b.depth > n.depth:
            n.article = (n.article or 0) + size
        while n is not None and n.serial not in elements:
            elements[n.serial] = n
            n = n.up
    for _, n in sorted(elements.items(), reverse=True):  # inner ones first
        holds_article = n.article is not None and (n.main or n.article >= left)
        n.lost = not (holds_article or not n.firm and 2 * n.good > total and (bare or n.depth > 0))
        if n.up:
            n.up.main |= n.main
            if not n.lost:
                n.up.good += n.good
                more = n.good if n.depth > n.up.depth else n.article
                if more is not None:
                    n.up.article = (n.up.article or 0) + more
    for _, n in sorted(elements.items()):
        n.lost |= n.up is not None and n.up.lost
    for b in found:
        b.dropped |= b.named is not None and b.named.lost


def _inherit(found: list[Block], prior: bool) -> None:
    """Second pass; what it decides serves no other block: only first-pass labels are inherited."""
    first = [b.label for b in found]
    ahead, behind = _nearest(found, first, False)
    own_ahead, own_behind = _nearest(found, first, True) if prior else (ahead, behind)
    for i, b in enumerate(found):
        if first[i] != "open":
            continue
        if prior and b.inside:
            b.label = "bad" if all(s and s[0] == "bad" for s in (own_behind[i], own_ahead[i])) else "good"
            continue
        sides = [s for s in (behind[i], ahead[i]) if s]
        if b.heading and ahead[i]:
            b.label = ahead[i][0]
        else:
            own = [s for s in sides if s[1] == b.container]
            b.label = "good" if any(s[0] == "good" for s in own) or len(sides) == 2 and all(s[0] == "good" for s in sides) else "bad"


def _nearest(found: list[Block], first: list[str], inside: bool) -> tuple[list, list]:
    """(label, container) of the nearest decided block after and before each block; inside: among
    what article and main elements hold and markup does not drop."""
    out = []
    for order in (range(len(found) - 1, -1, -1), range(len(found))):
        near, sides = None, [None] * len(found)
        for i in order:
            sides[i] = near
            if first[i] != "open" and (not inside or found[i].inside and not found[i].dropped):
                near = (first[i], found[i].container)
        out.append(sides)
    return out[0], out[1]


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    label(found)
    return "\n".join(b.text for b in found if b.label == "good")


def _extract(batches: Iterator) -> Iterator:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    common.small_batches(pages.sparkSession)
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")

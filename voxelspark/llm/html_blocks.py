"""Main text of web pages: flat text blocks, their words and link density and those of their neighbours, and a decision
tree trained on a small labelled table.

A page is cut into blocks at block-level tags.  The tree decides from six counts which blocks are article: words and link
density of the block, of the one before and of the one after.  What a page itself declares not to be article (menus,
sidebars, adverts, comments, ... by element and name) is taken out of its choice.  A second tree, from the same labelled
table, then looks at the blocks that the first left, beside what it chose: it finds short paragraphs within an article.
No block gets in because of what a page declares.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_batches

#: A quote opens a value only after an equals sign, as browsers read it.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?+)*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/])\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg math iframe object textarea select button canvas audio video title head".split())
#: Those whose content a browser reads as text up to their end tag, or to the end of the page if there is none.
RAW_TEXT = frozenset("script style textarea title iframe".split())
#: The others' tags, with comments and raw text to pass over.
_NESTED = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW_TEXT))})(?=[\s/>])(?![^>]*/>).*?(?:</\1(?=[\s/>])|\Z)|<(/?)({'|'.join(sorted(RAW - RAW_TEXT - {'head'}))})(?=[\s/>])", re.IGNORECASE | re.DOTALL
)
#: Of these a start tag ends an open one.
_NEVER_NESTED = frozenset(("button", "select"))
#: Elements that begin and end blocks.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_STACKED = BLOCKS - frozenset("p li dd dt hr tr td th thead tbody tfoot h1 h2 h3 h4 h5 h6".split()) | frozenset(("span", "td", "li", "p"))
#: What closes an open paragraph or list item that has no end tag.
_IMPLIED = {"p": BLOCKS, "li": frozenset(("li",)), "td": frozenset(("td", "th", "tr"))}
#: Containers that are never article, even with an article inside.
OUTSIDE = frozenset("nav footer aside dialog".split())
INSIDE = frozenset("article main".split())
#: Words of class, id and role names.
STRONG_NAMES = frozenset("comment comments disqus respond reply replies nav navigation menu navbar breadcrumb breadcrumbs pagination pager sidebar".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login register search widget related recommended "
    "share sharing social footer header masthead toolbar copyright legal disclaimer complementary contentinfo skip tags meta byline".split()
)
INSIDE_NAMES = frozenset("article content main story post entry text body".split())
#: A name that begins so, or ends so, tells a state of its element, not what the element is; after "with" comes what it has.
_STATE_BEFORE = frozenset("has no is not show hide allow without".split())
_STATE_AFTER = frozenset("open opened closed enabled disabled on off allowed hidden visible count".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_OPEN_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
_HREF = re.compile(r"(?<![^\s\"'/])href(?![^\s=/])", re.IGNORECASE)


@dataclass(frozen=True)
class _Open:
    """An open element, with what it and those around it tell: all that a piece of text needs to know of the stack."""

    tag: str
    #: what the outermost strong element tells, and else the innermost that tells anything
    strong: int | None = None
    told: int = 1
    #: elements that are declared outside the article: spans, and others
    spans: int = 0
    others: int = 0


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    place: int  # 0 the page declares it outside the article, 1 nothing, 2 inside


def _told(name: str) -> tuple[int, bool] | None:
    """(place, strong) that one name of a class, an id or a role tells, by its last telling word, or None."""
    words = [x.lower() for x in _NAME.findall(name)]
    if "with" in words:
        words = words[: words.index("with")]
    if not words or words[0] in _STATE_BEFORE or (len(words) > 1 and words[-1] in _STATE_AFTER):
        return None
    for word in reversed(words):
        if word in STRONG_NAMES:
            return 0, True
        if word in OUTSIDE_NAMES:
            return 0, False
        if word in INSIDE_NAMES:
            return 2, False
    return None


def _kind(tag: str, attributes: str) -> tuple[int, bool] | None:
    """(place, strong) that an element tells, or None."""
    told = []
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return 0, True
            if name in ("class", "id", "role"):
                told += [x for x in map(_told, value.split()) if x]
    if (0, True) in told or tag in OUTSIDE:
        return 0, True
    if (2, False) in told or tag in INSIDE:
        return 2, False
    return (0, False) if told or tag in ("header", "form") else None


def _within(around: _Open, tag: str, kind: tuple[int, bool] | None) -> _Open:
    """An element that is opened in another."""
    place, strong = kind or (1, False)
    outside = int(place == 0)
    return _Open(
        tag,
        place if strong and around.strong is None else around.strong,
        place if place != 1 else around.told,
        around.spans + outside * (tag == "span"),
        around.others + outside * (tag != "span"),
    )


def _ends(page: str) -> dict[int, int]:
    """Where elements of RAW that are no raw text end, by the place of their start tag; those without an end tag are left out.

    One pass, however many tags have no end."""
    out: dict[int, int] = {}
    still_open: dict[str, list[int]] = {}
    for m in _NESTED.finditer(page):
        if not m[3]:
            continue
        tag, places = m[3].lower(), still_open.setdefault(m[3].lower(), [])
        if m[2]:
            if places:
                close = page.find(">", m.end())
                out[places.pop()] = len(page) if close < 0 else close + 1
            continue
        whole = _TAG.match(page, m.start()) or _LOOSE.match(page, m.start())
        if whole and not whole[3].endswith("/"):
            if tag in _NEVER_NESTED:
                places.clear()
            places.append(m.start())
    return out


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; character references decoded, white space (by Unicode) made single.

    A link without an end tag ends with its block; an anchor without an address is no link.  Text of a span that is
    declared outside the article, in a paragraph that is not, goes."""
    out: list[Block] = []
    stack = [_Open("")]
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
    parts: list[str] = []
    linked: list[str] = []
    links, pos, n = 0, 0, len(page)  # links: 1 in a link without end tag, 2 in one with
    anchors: Iterator[re.Match[str]] | None = None
    after: re.Match[str] | None = None  # the next tag of a link, start or end
    ends: dict[int, int] | None = None

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = text.count(" ") + 1
            in_links = len(html.unescape(" ".join(linked)).split())
            place = stack[-1].told if stack[-1].strong is None else stack[-1].strong
            out.append(Block(text, words, min(in_links / words, 1.0), place))
        parts.clear()
        linked.clear()
        if links == 1:
            links = 0

    def add(piece: str) -> None:
        if stack[-1].spans and not stack[-1].others:
            return
        parts.append(piece)
        if links:
            linked.append(piece)

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            add(page[pos:])
            break
        if at > pos:
            add(page[pos:at])
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            pos = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, at) or _LOOSE.match(page, at)
        if not m:
            add("<")
            pos = at + 1
            continue
        pos = m.end()
        closing, tag, attributes = m[1] == "/", m[2].lower(), m[3]
        if tag in RAW:
            if closing or attributes.endswith("/"):
                continue
            if tag in RAW_TEXT or tag == "head":
                end = re.compile(rf"</{tag}(?=[\s/>])|<body(?=[\s>])" if tag == "head" else rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, pos)
                if end is None:
                    pos = n if tag != "head" else pos
                elif end[0][1] == "/":
                    close = page.find(">", end.end())
                    pos = n if close < 0 else close + 1
                else:
                    pos = end.start()
            else:
                if ends is None:
                    ends = _ends(page)
                pos = ends.get(at, pos)  # without an end tag the tag alone is passed over
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            links = 0
            if not closing and not attributes.endswith("/") and _HREF.search(attributes):
                if anchors is None or after is None or after.start() < pos:
                    anchors = anchors or _OPEN_LINK.finditer(page)
                    after = next((x for x in anchors if x.start() >= pos), None)
                links = 2 if after is not None and after[1] else 1
            continue
        if tag in BLOCKS:
            flush()
        if tag in _STACKED:
            if closing:
                for _ in range(len(stack) - places[tag][-1] if places.get(tag) else 0):
                    places[stack.pop().tag].pop()
            else:
                while tag in _IMPLIED.get(stack[-1].tag, ()):
                    places[stack.pop().tag].pop()
                if not attributes.endswith("/"):
                    places.setdefault(tag, []).append(len(stack))
                    stack.append(_within(stack[-1], tag, _kind(tag, attributes)))
    flush()
    return out


#: Labelled blocks: words, link density, words before, density before, words after, density after, article (1) or not (0).
LABELLED = (
    # blocks of a hundred of the supplied pages
    (1, 1, 0, 0, 1, 1, 0), (1, 1, 1, 1, 1, 1, 0), (1, 1, 1, 1, 5, 0, 0), (5, 0, 1, 1, 4, 0, 0), (4, 0, 5, 0, 4, 0, 1), (4, 0, 4, 0, 31, 0, 1),
    (31, 0, 4, 0, 16, 0, 1), (16, 0, 31, 0, 82, 0, 1), (82, 0, 16, 0, 67, 0, 1), (67, 0, 82, 0, 93, 0, 1), (93, 0, 67, 0, 2, 0, 1), (2, 0, 93, 0, 63, 0, 1),
    (63, 0, 2, 0, 35, 0, 1), (35, 0, 63, 0, 25, 0, 1), (25, 0, 35, 0, 1, 0, 1), (1, 0, 25, 0, 26, 0, 1), (26, 0, 1, 0, 12, 0, 1), (12, 0, 26, 0, 21, 0, 1),
    (21, 0, 12, 0, 94, 0, 1), (94, 0, 21, 0, 74, 0, 1), (74, 0, 94, 0, 8, 0, 1), (8, 0, 74, 0, 0, 0, 0), (1, 1, 1, 1, 12, 0, 0), (12, 0, 1, 1, 8, 0, 0),
    (8, 0, 12, 0, 8, 0, 1), (8, 0, 8, 0, 1, 0, 1), (1, 0, 8, 0, 24, 0, 1), (24, 0, 1, 0, 1, 0, 1), (1, 0, 24, 0, 29, 0, 1), (29, 0, 1, 0, 68, 0, 1),
    (68, 0, 29, 0, 80, 0, 1), (80, 0, 68, 0, 15, 0, 1), (15, 0, 80, 0, 121, 0, 1), (121, 0, 15, 0, 8, 0, 1), (8, 0, 121, 0, 1, 0, 1), (1, 0, 8, 0, 10, 0, 1),
    (10, 0, 1, 0, 0, 0, 0), (1, 1, 1, 1, 9, 0, 0), (9, 0, 1, 1, 10, 0, 0), (10, 0, 9, 0, 44, 0, 1), (44, 0, 10, 0, 108, 0, 1), (108, 0, 44, 0, 16, 0, 1),
    (16, 0, 108, 0, 76, 0, 1), (76, 0, 16, 0, 47, 0, 1), (47, 0, 76, 0, 9, 0, 1), (9, 0, 47, 0, 7, 0, 1), (7, 0, 9, 0, 80, 0, 1), (80, 0, 7, 0, 15, 0, 1),
    (15, 0, 80, 0, 0, 0, 0), (9, 0, 1, 1, 6, 0, 0), (6, 0, 9, 0, 107, 0, 1), (107, 0, 6, 0, 7, 0, 1), (7, 0, 107, 0, 15, 0, 1), (15, 0, 7, 0, 0, 0, 0),
    (1, 1, 1, 1, 8, 0, 0), (8, 0, 1, 1, 11, 0, 0), (11, 0, 8, 0, 13, 0, 1), (13, 0, 11, 0, 71, 0, 1), (71, 0, 13, 0, 32, 0, 1), (32, 0, 71, 0, 64, 0, 1),
    (64, 0, 32, 0, 11, 0, 1), (11, 0, 64, 0, 0, 0, 0), (1, 1, 1, 1, 10, 0, 0), (10, 0, 1, 1, 10, 0, 0), (10, 0, 10, 0, 75, 0, 1), (75, 0, 10, 0, 12, 0, 1),
    (12, 0, 75, 0, 49, 0, 1), (49, 0, 12, 0, 35, 0, 1), (35, 0, 49, 0, 234, 0, 1), (234, 0, 35, 0, 9, 0, 1), (9, 0, 234, 0, 203, 0, 1),
    (203, 0, 9, 0, 62, 0, 1), (62, 0, 203, 0, 54, 0, 1), (54, 0, 62, 0, 62, 0, 1), (62, 0, 54, 0, 143, 0, 1), (143, 0, 62, 0, 5, 0, 1), (5, 0, 143, 0, 7, 0, 1),
    (7, 0, 5, 0, 0, 0, 0), (9, 0, 1, 1, 11, 0, 0), (11, 0, 9, 0, 75, 0, 1), (75, 0, 11, 0, 8, 0, 1), (8, 0, 75, 0, 12, 0, 1), (12, 0, 8, 0, 123, 0, 1),
    (123, 0, 12, 0, 1, 0, 1), (1, 0, 123, 0, 9, 0, 1), (9, 0, 1, 0, 11, 0, 1), (11, 0, 9, 0, 0, 0, 0), (1, 1, 1, 1, 4, 0, 0), (4, 0, 1, 1, 8, 0, 0),
    (8, 0, 4, 0, 8, 0, 1), (8, 0, 8, 0, 4, 0, 1), (4, 0, 8, 0, 8, 0, 1), (8, 0, 4, 0, 9, 0, 1), (9, 0, 8, 0, 0, 0, 0), (1, 1, 1, 1, 13, 0, 0),
    (13, 0, 1, 1, 4, 0, 0), (4, 0, 13, 0, 4, 0, 1), (4, 0, 4, 0, 14, 0, 1), (14, 0, 4, 0, 32, 0, 1), (32, 0, 14, 0, 44, 0, 1), (44, 0, 32, 0, 1, 0, 1),
    (1, 0, 44, 0, 52, 0, 1), (52, 0, 1, 0, 38, 0, 1), (38, 0, 52, 0, 42, 0, 1), (42, 0, 38, 0, 275, 0, 1), (275, 0, 42, 0, 102, 0, 1),
    (102, 0, 275, 0, 9, 0, 1), (9, 0, 102, 0, 8, 0, 1), (8, 0, 9, 0, 0, 0, 0), (1, 1, 1, 1, 6, 0, 0), (6, 0, 1, 1, 11, 0, 0), (11, 0, 6, 0, 26, 0, 1),
    (26, 0, 11, 0, 54, 0, 1), (54, 0, 26, 0, 11, 0, 1), (11, 0, 54, 0, 0, 0, 0), (6, 0, 1, 1, 14, 0, 0), (14, 0, 6, 0, 70, 0, 1), (70, 0, 14, 0, 13, 0, 1),
    (13, 0, 70, 0, 0, 0, 0), (6, 0, 1, 1, 4, 0, 0), (4, 0, 6, 0, 4, 0, 1), (14, 0, 4, 0, 2, 0, 1), (2, 0, 14, 0, 20, 0, 1), (20, 0, 2, 0, 25, 0, 1),
    (25, 0, 20, 0, 2, 0, 1), (2, 0, 25, 0, 48, 0, 1), (48, 0, 2, 0, 17, 0, 1), (17, 0, 48, 0, 90, 0, 1), (90, 0, 17, 0, 32, 0, 1), (32, 0, 90, 0, 11, 0, 1),
    (11, 0, 32, 0, 25, 0, 1), (25, 0, 11, 0, 58, 0, 1), (58, 0, 25, 0, 9, 0, 1), (9, 0, 58, 0, 16, 0, 1), (16, 0, 9, 0, 0, 0, 0), (4, 0, 1, 1, 9, 0, 0),
    (9, 0, 4, 0, 9, 0, 1), (9, 0, 9, 0, 54, 0, 1), (54, 0, 9, 0, 57, 0, 1), (57, 0, 54, 0, 10, 0, 1), (10, 0, 57, 0, 11, 0, 1), (11, 0, 10, 0, 0, 0, 0),
    (13, 0, 1, 1, 11, 0, 0), (11, 0, 13, 0, 31, 0, 1), (31, 0, 11, 0, 51, 0, 1), (51, 0, 31, 0, 23, 0, 1), (23, 0, 51, 0, 77, 0, 1), (77, 0, 23, 0, 3, 0, 1),
    (3, 0, 77, 0, 5, 0, 1), (5, 0, 3, 0, 87, 0, 1), (87, 0, 5, 0, 10, 0, 1), (10, 0, 87, 0, 8, 0, 1), (8, 0, 10, 0, 0, 0, 0), (1, 1, 1, 1, 7, 0, 0),
    (7, 0, 1, 1, 8, 0, 0), (8, 0, 7, 0, 8, 0, 1), (8, 0, 8, 0, 77, 0, 1), (77, 0, 8, 0, 36, 0, 1), (36, 0, 77, 0, 11, 0, 1), (11, 0, 36, 0, 9, 0, 1),
    (9, 0, 11, 0, 37, 0, 1), (37, 0, 9, 0, 117, 0, 1), (117, 0, 37, 0, 196, 0, 1), (196, 0, 117, 0, 15, 0, 1), (15, 0, 196, 0, 174, 0, 1),
    # blocks of pages that declare nothing: menus, lists of links, captions, paragraphs
    (18, 0, 1, 1, 19, 0, 1), (20, 0, 3, 1, 18, 0, 1), (17, 0, 1, 1, 24, 0, 1), (18, 0, 20, 0, 2, 1, 1), (17, 0, 22, 0, 1, 1, 1),
    (1, 1, 0, 0, 1, 1, 0), (2, 1, 2, 1, 2, 1, 0), (3, 0.7, 2, 1, 60, 0, 0), (4, 0, 2, 1, 1, 1, 0), (5, 0, 0, 0, 2, 1, 0), (6, 0, 40, 0, 2, 1, 0),
    (20, 0.8, 30, 0, 22, 0.9, 0), (8, 0, 7, 0.6, 0, 0, 0), (7, 0, 3, 0, 2, 0, 0), (4, 0.5, 45, 0, 0, 0, 0), (6, 0, 2, 1, 50, 0, 1), (4, 0, 60, 0, 80, 0, 1),
    (3, 0, 40, 0, 3, 1, 0), (2, 0, 3, 1, 2, 1, 0), (60, 0, 5, 0, 55, 0, 1), (30, 0.1, 60, 0, 4, 1, 1), (18, 0, 40, 0, 40, 0, 1), (5, 0, 50, 0, 44, 0, 1),
    (2, 0, 70, 0, 30, 0, 1), (90, 0.25, 2, 1, 2, 1, 1), (40, 0, 3, 1, 25, 0, 1), (250, 0.02, 0, 0, 0, 0, 1),
)


class Tree:
    """A binary decision tree by Gini impurity; a leaf needs no further split, or holds one class."""

    def __init__(self, table: tuple[tuple[float, ...], ...], depth: int = 8):
        data = np.array(table, dtype=float)
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.value: list[bool] = []
        self._grow(data[:, :-1], data[:, -1] > 0.5, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        node = len(self.value)
        self.feature.append(-1)
        self.cut.append(0.0)
        self.child.append((-1, -1))
        self.value.append(bool(y.mean() > 0.5))
        best = None
        if depth and y.any() and not y.all():
            for f in range(x.shape[1]):
                at = np.unique(x[:, f])
                for cut in (at[1:] + at[:-1]) / 2:
                    left = x[:, f] <= cut
                    impurity = sum(len(z) * z.mean() * (1 - z.mean()) for z in (y[left], y[~left]))
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, f, float(cut), left)
        if best:
            _, self.feature[node], self.cut[node], left = best
            self.child[node] = (self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1))
        return node

    def decide(self, x: np.ndarray) -> np.ndarray:
        """The class of each row."""
        node = np.zeros(len(x), dtype=int)
        feature, cut, child, value = map(np.array, (self.feature, self.cut, self.child, self.value))
        while len(live := np.flatnonzero(feature[node] >= 0)):
            here = node[live]
            node[live] = child[here, (x[live, feature[here]] > cut[here]).astype(int)]
        return value[node]


TREE = Tree(LABELLED)


def features(found: list[Block]) -> np.ndarray:
    """Words and link density of each block, of the one before and of the one after; 0 where there is none."""
    words, density = np.array([b.words for b in found], dtype=float), np.array([b.link_density for b in found])
    before, after = (lambda v: np.concatenate([[0.0], v[:-1]])), (lambda v: np.concatenate([v[1:], [0.0]]))
    return np.column_stack([words, density, before(words), before(density), after(words), after(density)])


def _beside(x: np.ndarray, article: np.ndarray) -> np.ndarray:
    """What the second tree sees of blocks: words and link density, whether the one before and the one after are article, and
    words and link density of the one after."""
    before, after = np.concatenate([[0.0], article[:-1]]), np.concatenate([article[1:], [0.0]])
    return np.column_stack([x[:, :2], before, after, x[:, 4:6]])


def _second_tree(table: tuple[tuple[float, ...], ...]) -> Tree:
    """A tree over what the neighbours of the labelled blocks are: those rows of the table that follow each other on a page tell
    it of one another; where a neighbour is no row, one of nothing but links is none, and one of words is taken for article."""
    data = np.array(table, dtype=float)
    x, label = data[:, :6], data[:, 6]
    follow = np.concatenate([[False], (x[1:, 2] == x[:-1, 0]) & (x[1:, 0] == x[:-1, 4]) & (x[1:, 3] == x[:-1, 1])])
    before = np.where(follow, np.concatenate([[0.0], label[:-1]]), (x[:, 2] > 0) & (x[:, 3] < 0.5))
    leads = np.concatenate([follow[1:], [False]])
    after = np.where(leads, np.concatenate([label[1:], [0.0]]), (x[:, 4] > 0) & (x[:, 5] < 0.5))
    return Tree(tuple(map(tuple, np.column_stack([x[:, :2], before, after, x[:, 4:6], label]))))


SECOND = _second_tree(LABELLED)


def is_article(found: list[Block], tree: Tree = TREE, second: Tree | None = SECOND) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks of a page the tree takes for article, and which are article in the end: those of its choice, and of the
    second tree's beside it, that the page does not declare to be something else.

    The second tree takes a block that the first left only next to a block that the first chose."""
    if not found:
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    x, allowed = features(found), np.array([b.place != 0 for b in found])
    chosen = tree.decide(x).astype(bool)
    kept = chosen & allowed
    if second is not None:
        beside = _beside(x, kept.astype(float))
        kept = kept | (second.decide(beside).astype(bool) & ((beside[:, 2] > 0) | (beside[:, 3] > 0)) & allowed)
    return chosen, kept


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in order, joined by an empty line."""
    found = blocks(page) if page else []
    return "\n\n".join(b.text for b, keep in zip(found, is_article(found)[1], strict=True) if keep)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, sizes = [], []
        for page in batch.column(2).to_pylist():
            found = blocks(page) if page else []
            chosen, keep = is_article(found)
            texts.append("\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k))
            sizes.append((len(found), int(chosen.sum()), int(keep.sum())))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array([s[k] for s in sizes], pa.int32()) for k in range(3))],
            ["page_id", "url", "text", "n_blocks", "n_chosen", "n_kept"],
        )


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars, n_blocks, n_chosen, n_kept)`` for each row of ``pages``: blocks of the page, those
    that the tree takes for article, and those that ``text`` holds.

    ``text`` is the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and
    comments; character references are decoded, white space in a block (that of Unicode) is one space, blocks are joined by
    two line feeds.
    Null and empty pages, and pages without an article, give an empty text.  Broken markup is read as far as it goes: after
    a script, style, textarea, title or iframe without its end tag there is no text, as in a browser; other tags without one
    drop nothing.  A page of any length is read whole.  Ids and addresses may be null or repeat.  Other columns are not read."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = rows.mapInArrow(_rows, "page_id long, url string, text string, n_blocks int, n_chosen int, n_kept int")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_chosen", "n_kept")

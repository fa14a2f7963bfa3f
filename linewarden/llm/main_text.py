"""Main text of web pages by scoring the element tree.

Each paragraph passes points for its length and commas to the element around it, and half of them
to the next one, discounted by the share of its text in links.  If the element with the most points
lies in an article, that article is the content, with the other articles of the same ``main``.  Else
the element is the content, with what stands beside it and beside the elements around it: paragraphs
and headings, and containers that have a heading or a good share of its points.  What is nearly all
links goes.  What is no article by its tag, role, class or id never enters the tree; for a paragraph
or a heading inside an article the name alone is no sign of it.

Defined cases: null html is an empty page and has an empty text; a page whose every part is left
out has an empty text; unclosed and misnested tags end with the element around them; a repeated row
is extracted each time; further columns are kept, except those named like an output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.
DROPPED = frozenset((
    "aside", "audio", "button", "canvas", "datalist", "dialog", "embed", "fieldset", "footer",
    "form", "head", "iframe", "input", "label", "map", "menu", "nav", "noscript", "object",
    "optgroup", "option", "picture", "script", "select", "style", "svg", "template", "textarea",
    "title", "video",
))
DROPPED_ROLES = frozenset((
    "alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu",
    "menubar", "navigation", "search", "toolbar",
))
#: Words of a class or an id that tell what is no article.
DROPPED_WORDS = frozenset((
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus",
    "footer", "gdpr", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo",
    "promoted", "promotion", "recommended", "related", "replies", "respond", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar",
    "widget", "widgets",
))
#: Words that say how a part is arranged, and words of article parts.
ARRANGED_WORDS = frozenset(("has", "no", "with", "without"))
CONTENT_WORDS = frozenset(("article", "content", "entry", "post", "story"))
BLOCKS = frozenset((
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl",
    "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
    "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An element that ends when one of these begins inside it, up to the element that bounds it.
ENDED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
BOUNDS = frozenset("article aside body div dl main ol section table td th ul".split())
#: Points an element has before any paragraph passes it some.
START = {"article": 25.0, "main": 25.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0,
         "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "address": -3.0, "th": -5.0}
#: From this share of link text on, such an element is a menu, and anything beside the content.
MENUS, MENU_LINKS = frozenset(("div", "dl", "ol", "section", "table", "ul")), 0.8
#: Containers that say nothing of what they hold, and the share of the best one's points from which
#: one beside it is content.
PLAIN, CONTENT_SHARE = frozenset(("center", "details", "div", "header", "section")), 0.2

_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "parent", "items", "points", "size", "linked", "anchors")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.items: list[Element | str] = []
        self.points = START.get(tag, 0.0)
        self.size = self.linked = self.anchors = 0

    @property
    def link_share(self) -> float:
        return self.linked / self.size if self.size else 0.0


def _words(value: str) -> set[str]:
    """Words of a class or id, also of names written together with a capital."""
    return set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))


def _outside_article(at: Element | None) -> bool:
    while at is not None and at.tag not in ("article", "main"):
        at = at.parent
    return at is None


def _dropped(tag: str, attrs: list[tuple[str, str | None]], parent: Element) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header" and _outside_article(parent):  # the head of the page, not of the article
        return True
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    is_text = tag == "p" or tag in HEADINGS
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id"):
            words = _words(value)
            if words & ARRANGED_WORDS:  # an arrangement of the page, not a part of it
                continue
            if words & DROPPED_WORDS and ("hidden" in words or not is_text or _outside_article(parent)):
                return True
            if "header" in words and not words & CONTENT_WORDS and _outside_article(parent):
                return True
    return False


class TreeBuilder(HTMLParser):
    """The tree of what may be article text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", None)
        self._at = self.root
        self._skipped: list[str] = []  # open elements below a dropped one

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if self._skipped:
            if tag not in VOID and (tag in BLOCKS or tag in DROPPED):
                self._skipped.append(tag)
            return
        self._end_before(tag)
        if tag in VOID:
            self._at.items.append(Element(tag, self._at))
        elif _dropped(tag, attrs, self._at):
            self._skipped.append(tag)
        else:
            child = Element(tag, self._at)
            self._at.items.append(child)
            self._at = child

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _end_before(self, tag: str) -> None:
        at = self._at
        while at.parent is not None:
            if tag in ENDED_BY.get(at.tag, ()):
                self._at = at.parent
                at = self._at
                continue
            if at.tag in BOUNDS:
                return
            at = at.parent

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if self._skipped:
            if tag in self._skipped:
                while self._skipped.pop() != tag:
                    pass
            return
        at = self._at
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self._at = at.parent

    def handle_data(self, data):
        if not self._skipped:
            self._at.items.append(data)


def _elements(root: Element) -> list[Element]:
    """Elements in page order, without recursion: pages nest as deep as they like."""
    found, stack = [], [root]
    while stack:
        at = stack.pop()
        found.append(at)
        stack.extend(x for x in reversed(at.items) if isinstance(x, Element))
    return found


def _measured(root: Element) -> list[Element]:
    """Text and link text of every element, menus cut out."""
    elements = _elements(root)
    for at in reversed(elements):
        at.size = at.linked = at.anchors = 0
        kept = []
        for item in at.items:
            if isinstance(item, str):
                at.size += len(item.strip())
            else:
                if item.tag in MENUS and item.anchors > 1 and item.link_share >= MENU_LINKS:
                    continue
                at.size += item.size
                at.linked += item.linked
                at.anchors += item.anchors
            kept.append(item)
        at.items = kept
        if at.tag == "a":
            at.linked, at.anchors = at.size, 1
    return elements


def _blocks(root: Element) -> list[tuple[str, Element]]:
    """Blocks of text in page order, each with the innermost block element around it."""
    found: list[tuple[str, Element]] = []
    parts: list[str] = []
    # what is still to come, last first; a block element stands again where it ends
    stack: list[tuple[Element | str, Element, bool]] = [(root, root, False)]

    def end(owner: Element) -> None:
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                found.append((text, owner))

    while stack:
        item, owner, ends = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif ends:
            end(item)
        elif item.tag == "br":
            parts.append(" ")
        elif item.tag in BLOCKS:
            end(owner)
            stack.append((item, item, True))
            stack.extend((x, item, False) for x in reversed(item.items))
        else:
            stack.extend((x, owner, False) for x in reversed(item.items))
    return found


def _paragraph(tag: str) -> bool:
    """Whether a block's text belongs to the element around it, not to the block itself."""
    return tag in ("p", "li", "dd", "dt", "pre", "td", "th", "blockquote", "caption", "figcaption",
                   "summary", "address") or tag in HEADINGS


def _beside(items: list[Element | str], content: Element, points: float) -> list[Element | str]:
    """The content and what belongs to it of what stands beside it.

    Blocks and lines of text that are nearly all links do not, nor plain containers without a
    heading whose points are few.
    """
    kept, line = [], []

    def belongs(item: Element) -> bool:
        if item.tag in HEADINGS:
            return True
        if item.anchors > 1 and item.link_share >= MENU_LINKS:
            return False
        return item.tag not in PLAIN or item.points >= points or any(
            e.tag in HEADINGS and e.size for e in _elements(item)
        )

    def end() -> None:
        size = sum(len(x.strip()) if isinstance(x, str) else x.size for x in line)
        inline = [x for x in line if isinstance(x, Element)]
        if not (sum(x.anchors for x in inline) > 1
                and sum(x.linked for x in inline) >= MENU_LINKS * size):
            kept.extend(line)
        line.clear()

    for item in items:
        if isinstance(item, str) or (item is not content and item.tag not in BLOCKS):
            line.append(item)
            continue
        end()
        if item is content or belongs(item):
            kept.append(item)
    end()
    return kept


def _content(root: Element) -> list[Element]:
    elements = _measured(root)
    for text, owner in _blocks(root):
        points = (min(len(text) / 25, 1) + text.count(",") + min(len(text) / 100, 3))
        points *= 1 - owner.link_share
        first = owner.parent if _paragraph(owner.tag) and owner.parent else owner
        first.points += points
        if first.parent:
            first.parent.points += points / 2
    holders = [e for e in elements if e.size and not _paragraph(e.tag) and e.tag in BLOCKS]
    if not holders:
        return []
    best = max(holders, key=lambda e: e.points * (1 - e.link_share))
    # all of an article is content, though one of its parts has the most points
    at = best
    while at is not None and at.tag not in ("article", "main"):
        at = at.parent
    if at is not None:
        return _articles(at)
    points = CONTENT_SHARE * best.points
    while best.parent is not None:
        best.parent.items = _beside(best.parent.items, best, points)
        best = best.parent
    return [best]


def _articles(article: Element) -> list[Element]:
    """The article, and the others of the innermost ``main`` around it, in page order."""
    main = article
    while main is not None and main.tag != "main":
        main = main.parent
    if main is None or main is article:
        return [article]
    found, stack = [], [main]
    while stack:  # an article inside an article is part of it
        at = stack.pop()
        if at.tag == "article":
            found.append(at)
        else:
            stack.extend(x for x in reversed(at.items) if isinstance(x, Element))
    return found


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return "\n\n".join(text for part in _content(builder.root) for text, _ in _blocks(part))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with ``text`` and ``n_chars``."""
    kept = pages.drop("text", "n_chars")
    names = [c for c in kept.columns if c != "html"]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.string())],
                names=[*names, "text"],
            )

    fields = [kept.schema[c] for c in names]
    schema = StructType(fields).add("text", "string")
    rows = kept.select(*names, F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(extracted, schema).withColumn("n_chars", F.length("text").cast("long"))

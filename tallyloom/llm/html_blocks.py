"""Leaf blocks of a page: its text between block-level tags, with their ancestors.

Every step takes time in proportion to the page, however deep its elements are
nested and whatever is left open: an element knows what it inherits, places of open
elements are kept by tag, and a quote without an end is looked for once.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

# Element names of the markup language by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom msub msup"
    " msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split()
)
INLINE = (
    frozenset(
        "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q"
        " rp rt ruby s samp small span strike strong sub sup time tt u var"
        " area embed img input link meta param source track wbr"
        " audio button canvas datalist object picture select svg template video"
        " annotation annotation-xml option optgroup".split()
    )
    | MATH
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre"
    " section summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is never text of the page.
RAW = frozenset("script style title textarea noscript noembed noframes iframe xmp".split())
DROPPED = frozenset("head template svg select button datalist annotation annotation-xml".split())
#: What a head can hold; anything else ends it.
OF_HEAD = frozenset("base link meta script style title noscript template".split())
#: Dropped elements that end where a block begins, if nothing ends them before.
ENDED_BY_BLOCKS = ("svg", "select", "button", "datalist", "annotation", "annotation-xml")
#: A start tag that ends an open element of the same kind, not looking past the others.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
# Elements, and words of class, id and role, that tell about a block.
TAGS = (
    "a", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "label", "li",
    "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "ul",
)
WORDS = {
    "advert": "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored"
    " promo promotion banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc",
    "side": "sidebar side widget widgets related recommended recommendations trending popular"
    " complementary",
    "foot": "footer foot copyright legal bottom contentinfo colophon",
    "head": "header masthead topbar top logo branding",
    "notice": "cookie cookies consent gdpr notice popup modal alert overlay dialog toast"
    " newsletter subscribe signup paywall",
    "comment": "comment comments reply replies respond discussion disqus feedback",
    "share": "share sharing social follow",
    "form": "form login search register",
    "content": "content article post entry story body text main prose page",
    "meta": "byline author meta date tags category",
}
KIND = {word: kind for kind, words in WORDS.items() for word in words.split()}

_OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_COMMENT = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_NOTHING: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Block:
    """Its text, its innermost element, those around it, kinds of their words, its links.

    Of elements around it only ``TAGS`` are told, of words of class, id and role only
    their kinds (``KIND``), so that a block is small however deep it lies.
    """

    text: str
    inner: str | None
    tags: frozenset[str]
    kinds: frozenset[str]
    link_chars: int


@dataclass(frozen=True)
class _Element:
    """An open element, with what it has and what it has from those around it."""

    tag: str
    tags: frozenset[str]
    kinds: frozenset[str]
    hidden: bool
    in_link: bool
    foreign: bool


_ROOT = _Element("", _NOTHING, _NOTHING, False, False, False)


def _said(attributes: str) -> tuple[set[str], bool]:
    """Kinds of the words of class, id and role, and whether the element is hidden."""
    kinds: set[str] = set()
    hidden = False
    for match in _ATTRIBUTE.finditer(attributes):
        name = match[1].lower()
        value = (match[2] or match[3] or match[4] or "").lower()
        if name in ("class", "id", "role"):
            kinds.update(KIND[word] for word in _WORD.findall(value) if word in KIND)
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style" and _HIDDEN.search(value):
            hidden = True
    return kinds, hidden


class _Page:
    def __init__(self) -> None:
        self.open = [_ROOT]
        #: Where elements of a tag, and those that are not inline, are among the open ones.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.outer = [0]
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.link_chars = 0
        self.around: _Element | None = None

    def text(self, raw: str) -> None:
        if not raw:
            return
        blank = raw.isspace()
        if not blank and self.open[-1].tag == "head":
            self._close_to(len(self.open) - 1)
        now = self.open[-1]
        if now.hidden:
            return
        if blank:
            self.parts.append(" ")
            return
        if "&" in raw:
            raw = html.unescape(raw)
        if not raw.isspace() and self.around is None:
            self.around = now
        self.parts.append(raw)
        if now.in_link:
            self.link_chars += len(raw)

    def flush(self) -> None:
        if self.around is not None:
            text = " ".join("".join(self.parts).split())
            one = self.around
            if text:
                links = min(self.link_chars, len(text))
                self.blocks.append(Block(text, one.tag or None, one.tags, one.kinds, links))
        self.parts, self.link_chars, self.around = [], 0, None

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[tag][-1] for tag in tags if self.places[tag]), default=0)

    def start(self, tag: str, attributes: str) -> None:
        if self.open[-1].tag == "head" and tag not in OF_HEAD:
            self._close_to(len(self.open) - 1)
        if tag == "br":
            self.text(" ")
        elif tag in BLOCKS:
            self.flush()
            if ended := self._last(ENDED_BY_BLOCKS):
                self._close_to(ended)
        elif tag not in INLINE and not self.open[-1].foreign:
            self.flush()
        if tag == "p" and self.open[self.outer[-1]].tag == "p":
            self._close_to(self.outer[-1])
        elif tag in CLOSES:
            own, borders = CLOSES[tag]
            if (at := self._last(own)) > self._last(borders):
                self._close_to(at)
        up = self.open[-1]
        foreign = up.foreign or tag in ("svg", "math")
        if tag in VOID or foreign and attributes.endswith("/"):
            return
        kinds, hidden = _said(attributes) if attributes.strip(" /\n\t") else (_NOTHING, False)
        self.places[tag].append(len(self.open))
        if tag not in INLINE and not up.foreign:
            self.outer.append(len(self.open))
        self.open.append(
            _Element(
                tag,
                up.tags if tag in up.tags or tag not in TAGS else up.tags | {tag},
                up.kinds if kinds <= up.kinds else up.kinds | kinds,
                up.hidden or hidden or tag in DROPPED,
                up.in_link or tag == "a",
                foreign,
            )
        )

    def end(self, tag: str) -> None:
        at = self._last((tag,))
        if tag not in INLINE and not (at and self.open[at].foreign):
            self.flush()
        if at and (tag not in INLINE or at > self.outer[-1]):
            self._close_to(at)

    def _close_to(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()
            if self.outer[-1] == len(self.open):
                self.outer.pop()


class _Tags:
    """Finds where tags end. A quote that nothing ends is remembered, by its place."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.dead: set[int] = set()
        self.special = -1  # the first of > " ' from the place last asked for

    def end(self, at: int) -> int | None:
        """Place of the > that ends a tag whose attributes begin here; None if none does."""
        page = self.page
        if self.special < at:
            found = _SPECIAL.search(page, at)
            self.special = found.start() if found else len(page)
        here, met = self.special, []
        while here < len(page) and here not in self.dead:
            if page[here] == ">":
                return here
            met.append(here)
            close = page.find(page[here], here + 1)
            found = _SPECIAL.search(page, close + 1) if close >= 0 else None
            here = found.start() if found else len(page)
        self.dead.update(met)
        return None


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order; those of scripts, styles and hidden elements are left out.

    Markup need not be well formed: what is left open ends with its parent, a head
    at the first thing that is none of it, buttons and drawings where a block begins;
    an end tag without a start is ignored, and what isn't a tag is text. Character
    references are decoded and white space is turned into single blanks.
    """
    found, tags = _Page(), _Tags(page)
    unended: set[str] = set()
    at, size = 0, len(page)
    while at < size:
        less = page.find("<", at)
        if less < 0:
            found.text(page[at:])
            break
        found.text(page[at:less])
        if comment := _COMMENT.match(page, less):
            at = comment.end()
            continue
        opening = _OPENING.match(page, less)
        end = tags.end(opening.end()) if opening else None
        if end is None:
            found.text("<")
            at = less + 1
            continue
        at = end + 1
        tag = opening[2].lower()
        if opening[1]:
            found.end(tag)
        elif tag in RAW and tag not in unended:
            found.flush()
            close = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
            if close:
                at = close.end()
            elif tag in ("script", "style"):
                break  # the rest of the page is one
            else:  # nothing ends it, so it hides nothing
                unended.add(tag)
        elif tag not in RAW:
            found.start(tag, page[opening.end() : end])
    found.flush()
    return found.blocks

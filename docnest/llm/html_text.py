"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Parts that are never article text (menus, page headers, footers, sidebars, notices,
adverts, forms, comments, scripts, styles) are cut off by their tag, role or class. A word of the class alone does not cut a part
that another class calls article and that reads like prose, nor one that holds most of the page's prose, nor prose inside an article
under a word of double meaning (a section ``discussion``); these are left to the scores. Every paragraph left passes
points for its length and its commas to its parent, half of them to the grandparent, a sixth, an eighth, ... further up; an element's points
count less the more of its text is links. The element with most points is the container; if it lies in an ``article`` or
``main``, the outermost of these is. Its siblings, and those of the elements it lies in, are kept when they score like it, or are a heading,
a table or text that is not mostly links; other articles of the page are kept as well.

Text: character references decoded, white space in a block turned into one space, blocks joined by a line feed.
Defined results: null, empty and textless pages give an empty text; broken markup is closed where it must end. Of equal scores the first
element of the page is the container. Repeated rows and null ids are rows like any other, an empty table gives none. Pages are read
whole, whatever their length, and in time linear in it, however deep elements are nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docnest.llm.frames import mapped

# Fixed sets of HTML's element names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
HIDDEN = frozenset(
    "script style noscript template head title iframe object embed svg math canvas audio video map datalist select textarea button input".split()
)
#: Elements that end an open element of the second kind, unless one of the third kind lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_FENCE = frozenset({"table", "td", "th", "button", "object", "template", "html", "body"})

#: Words of class, id and role that mark a part as no article text, whatever it holds ...
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion comment comments commentlist "
    "discussion disqus respond replies cookie cookies consent gdpr notice notices notification newsletter subscribe subscription popup modal overlay paywall "
    "share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar skip alert dialog banner-ad".split()
)
#: ... and unless it holds the article.
SELDOM = frozenset(
    "nav navbar navigation navi menu menubar header masthead topbar footer foot bottombar copyright contentinfo sidebar side rail aside complementary widget widgets "
    "banner search login signup form legal disclaimer tags meta byline".split()
)
ARTICLE = frozenset("article post entry story main content".split())
#: Words of NEVER that an article also uses of its own sections.
DOUBLE = frozenset("discussion related recommended recommendations notice notices alert notification promotion social share sharing sponsor skip".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words said not to be there, or to be elsewhere: no-sidebar, layout--with-menu, ad-free.
_DENIED = re.compile(r"(?<![a-z])(?:has|have|no|not|non|with|without)[-_]+[a-z]+|(?<![a-z])[a-z]+[-_]+(?:free|less)(?![a-z])")
_WORDS = re.compile(r"[a-z]+")
#: Neighbours of the container that are text unless they are mostly links.
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure dl hgroup".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd dt figcaption h2 h3 h4 h5 h6 summary".split())
_BASE = {"article": 10, "main": 8, "div": 5, "section": 4, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "form": -3, "address": -3}


class Element:
    __slots__ = ("tag", "parent", "inside", "words", "called", "length", "links", "prose", "comments", "points", "gone", "scored", "raw", "commas")

    def __init__(self, tag: str, parent: Element | None, words: frozenset[str], called: bool, gone: bool):
        self.tag, self.parent, self.words, self.called, self.gone = tag, parent, words, called, gone
        self.inside: list[Element | str] = []
        self.length = self.links = self.prose = self.raw = self.commas = 0
        self.comments = False
        self.points, self.scored = 0.0, False

    def density(self) -> float:
        return self.links / self.length if self.length else 0.0


class _Tree(HTMLParser):
    """Open elements as a stack, and where in it each tag is, so that no tag is looked for element by element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Element("", None, frozenset(), False, False)
        self.open = [self.top]
        self.places: dict[str, list[int]] = {}
        self.every = [self.top]

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close_from(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()

    def _close_to(self, tags: set[str] | frozenset[str], fence: set[str] | frozenset[str]) -> None:
        limit = self._last(fence)
        while (place := self._last(tags)) > limit:
            self._close_from(place)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._close_to({"p"}, _FENCE)
        if tag in CLOSES:
            self._close_to(*CLOSES[tag])
        if tag == "body":
            self._close_to({"head"}, frozenset())
        named = {k: v or "" for k, v in attrs}
        names = [frozenset(_WORDS.findall(x)) for x in _DENIED.sub(" ", f"{named.get('class', '')} {named.get('id', '')} {named.get('role', '')}".lower()).split()]
        words = frozenset().union(*names)
        called = any(x & ARTICLE and not x & NEVER and not x & SELDOM for x in names)
        style = named.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        made = Element(tag, self.open[-1], words, called, tag in HIDDEN or hidden)
        self.open[-1].inside.append(made)
        self.every.append(made)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(made)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        place = self._last((tag,))
        within = tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html")
        if place and not (within and place < self._last(("td", "th"))):
            self._close_from(place)

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)


def parse(html: str) -> list[Element]:
    """All elements, parents before children; the first is the root."""
    tree = _Tree()
    tree.feed(html.replace("<![", "<!-["))
    tree.close()
    return tree.every


def _holders(every: list[Element]) -> set[Element]:
    """Elements with an article or main inside, comments aside."""
    holders: set[Element] = set()
    for e in every:
        if e.tag in ("article", "main") and not e.words & NEVER:
            up = e.parent
            while up is not None and up not in holders:
                holders.add(up)
                up = up.parent
    return holders


def _weigh(every: list[Element]) -> None:
    """``prose`` of every element: characters of its paragraphs that are not mostly links; and whether comments are inside."""
    for e in reversed(every):
        if e.gone:
            continue
        own = 0
        for x in e.inside:
            if isinstance(x, str):
                own += len(" ".join(x.split()))
            elif not x.gone:
                e.length += x.length
                e.links += x.links
                e.prose += x.prose
                e.comments |= x.comments or bool(x.words & _COMMENTS)
        e.length += own
        if e.tag == "a":
            e.links = e.length
        if e.length >= 25 and (e.tag in ("p", "pre", "blockquote", "td") or own >= 80 and e.tag in ("div", "section", "article")) and e.density() < 0.25:
            e.prose = e.length


def _outside(every: list[Element], articles: list[Element]) -> set[Element]:
    """Elements with prose of an article outside them."""
    own = dict.fromkeys(every, 0)  # prose of articles under each element
    marked = set(articles)
    under = set()
    for e in every:
        if e in marked or e.parent in under:
            under.add(e)
    for e in reversed(every):
        own[e] = e.prose if e in under else sum(own[x] for x in e.inside if not isinstance(x, str))
    return {e for e in every if own[e] < own[every[0]]}


def _spared(e: Element, inside: set[Element], page: int, outside: set[Element]) -> bool:
    """Whether words of its class are too little to cut an element."""
    strict = e.words & NEVER and (not e.words & DOUBLE or e.words & NEVER - DOUBLE)
    if not e.prose:
        return False
    if e.prose == page:  # else nothing would be left
        return True
    reads = e.prose * 2 > e.length and e.density() < 0.25
    if strict:
        return reads and e.called and e.prose * 2 > page and e not in outside
    if e.words & NEVER:
        return reads and not e.comments and (e in inside or e.called)
    return reads and e.called or e.prose * 2 > page and e not in outside


def _cut(every: list[Element]) -> None:
    """Mark the parts that are not article text, with all they hold."""
    _weigh(every)
    holders = _holders(every)
    page = every[0].prose
    called = [e for e in every if e.prose and (e.called or e.tag in ("article", "main")) and e.tag not in ("html", "body") and not e.words & NEVER]
    outside = _outside(every, called)
    inside: set[Element] = set()
    for e in every:
        up = e.parent
        if up is not None and (up in inside or up.tag in ("article", "main") or up.words & ARTICLE and up.tag not in ("html", "body")):
            inside.add(e)
        if up is not None and up.gone:
            e.gone = True
        elif e.tag in ("html", "body", "article", "main", ""):
            e.gone = e.gone or e.tag == "article" and bool(e.words & NEVER)
        elif e.words & NEVER and e.tag not in ("p", "h1", "b", "i", "em", "strong", "span"):
            e.gone = e.gone or not _spared(e, inside, page, outside)
        elif e.tag in ("nav", "aside", "footer", "search", "dialog", "menu") or e.tag == "form":
            e.gone = e.gone or e not in holders and not (e.tag == "form" and e.prose * 2 > page and e not in outside)
        elif e.tag == "header" or e.words & SELDOM and e.tag not in ("p", "h1", "b", "i", "em", "strong", "span"):
            e.gone = e.gone or e not in holders and not (e in inside and (e.tag == "header" or "header" in e.words)) and not (e.tag != "header" and _spared(e, inside, page, outside))


def _measure(every: list[Element]) -> None:
    """Length of the text and of its links, and its commas, in every element that is left."""
    for e in reversed(every):
        e.length = e.links = e.raw = e.commas = 0
        if e.gone:
            continue
        for x in e.inside:
            if isinstance(x, str):
                e.length += len(" ".join(x.split()))
                e.raw += len(x)
                e.commas += x.count(",") + x.count("、") + x.count("，")
            elif not x.gone:
                e.length += x.length
                e.links += x.links
                e.raw += x.raw
                e.commas += x.commas
        if e.tag == "a":
            e.links = e.length


def _score(every: list[Element]) -> None:
    for e in every:
        own = sum(len(x.strip()) for x in e.inside if isinstance(x, str)) if e.tag in ("div", "section", "article") else 0
        if e.gone or not (e.tag in PARAGRAPHS or own >= 80) or e.length < 25:
            continue
        points = 1 + e.commas + min(e.raw / 100, 3)
        up, level = (e if own >= 80 else e.parent), 0
        while up is not None and up.tag not in ("", "html") and level < 6:
            if not up.scored:
                up.scored, up.points = True, _BASE.get(up.tag, 0) + (5 if up.words & ARTICLE else 0)
            up.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1
    for e in every:
        e.points *= 1 - e.density()


def _strings(e: Element) -> Iterator[str]:
    """Texts under an element in page order, without the parts cut off."""
    stack = [iter(e.inside)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                yield x
            elif not x.gone:
                stack.append(iter(x.inside))
                break
        else:
            stack.pop()


def _blocks(roots: list[Element]) -> list[str]:
    """The text of every block under the elements, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    for root in roots:
        flush()
        stack: list[tuple[Element, Iterator]] = [(root, iter(root.inside))]
        while stack:
            e, rest = stack[-1]
            for x in rest:
                if isinstance(x, str):
                    run.append(x)
                elif x.gone:
                    continue
                elif x.tag == "br":
                    run.append(" ")
                else:
                    if x.tag in BLOCKS:
                        flush()
                    stack.append((x, iter(x.inside)))
                    break
            else:
                stack.pop()
                if e.tag in BLOCKS:
                    flush()
    flush()
    return out


def _belongs(x: Element, best: Element) -> bool:
    """Whether a neighbour of the container (or of what holds it) is text of the article: scored like it, a heading, a table, or text that is not mostly links."""
    if x.gone or not x.length:
        return False
    if x.scored and x.points >= min(max(10, best.points * 0.2), best.points * 0.5):
        return True
    return x.density() < (0.5 if x.tag in _TEXTS else 0.25) and (x.tag in _TEXTS or x.links == 0 or x.prose > 0)


def _chosen(every: list[Element]) -> list[Element]:
    """The container, the children of its ancestors that belong to it, and all articles, in page order."""
    scored = [e for e in every if e.scored and not e.gone]
    if not scored:
        left = [e for e in every if not e.gone and e.length]
        whole = [e for tag in ("article", "main", "body") for e in left if e.tag == tag]
        return whole[:1] or every[:1]
    best = max(scored, key=lambda e: e.points)
    holder, up = best, best
    while up is not None:
        if up.tag in ("article", "main"):
            holder = up
        up = up.parent
    kept = {holder}
    at = holder
    while at.parent is not None and at.tag not in ("body", "html"):
        kept.update(x for x in at.parent.inside if not isinstance(x, str) and x is not at and _belongs(x, best))
        at = at.parent
    kept.update(e for e in every if e.tag == "article" and not e.gone and e.prose and e.density() < 0.25)
    inside: set[Element] = set()
    out = []
    for e in every:  # nothing twice
        if e.parent in inside or e.parent in kept:
            inside.add(e)
        elif e in kept:
            out.append(e)
    return out


def main_text(html: str) -> str:
    every = parse(html)
    _cut(every)
    _measure(every)
    _score(every)
    return "\n".join(_blocks(_chosen(every)))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) if html else "" for html in batch.column("html").to_pylist()]
        made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *made], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    asked = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return mapped(asked, _extracted, f"page_id {kind}, url string, text string, n_chars long")

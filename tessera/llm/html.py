"""Main text of web pages by composite text density.

The page is read into a tree (implied end tags, raw-text elements, unclosed
markup).  Parts that never are article text go first: head, scripts, forms,
menus, site headers, footers, sidebars, and what is hidden.  An element whose class, id
or role names such a part goes only if nothing in it speaks for an article (see
``_prune``), as wrappers carry such names too; else its name halves its density.
For every node left, the composite density weighs its
characters per tag by how few of them stand in links.  The node whose children's
densities have the largest sum holds the article; the smallest density on
the path from it to the body is the threshold: a part beside that path joins only if it
is at least as dense.  Bare text beside the path is such a part too.  An article or main
element around the path vouches for its own paragraphs, headings and bare text,
except for lists of links.  Text is given per block, in page order.

Defined results: null html counts as empty; a page without text gives the empty
string; malformed markup never fails, a ``<`` that opens no tag is text; repeated rows
are read once each; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import html as entities
import math
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'<>])*+)>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)([^<>]*)>|<[!?][^>]*(?:>|\Z)|</[^>]*>",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")  # one attribute after another, values with their names
_NAME = re.compile(r"[a-z]+", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "head script style noscript template svg canvas object iframe textarea title nav footer aside form button "
    "select option input label dialog menu audio video map xmp noembed noframes fieldset annotation annotation-xml".split()
)
#: Elements inside which white space is kept together with their neighbours' text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img math semantics mrow mi mn mo ms mtext msub msup msubsup mfrac msqrt mroot munder mover munderover mspace mstyle".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre ul ol dl figure table".split())
_P_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
#: A start tag of the key ends open elements of the value, up to the enclosing element named third.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: Words in a class, id or role that name a part beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner "
    "sidebar aside rail menu navbar nav navigation breadcrumb breadcrumbs pagination pager toolbar topbar footer foot copyright "
    "header masthead comment comments commentlist disqus replies reply respond discussion cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay dialog newsletter subscribe subscription signup login signin search "
    "share sharing social related recommended recommendations trending popular widget widgets teaser skip disclaimer "
    "complementary contentinfo legal paywall".split()
)
#: Of these, words that name adverts and readers' talk; the others name places of a layout.
FOREIGN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted "
    "comment comments commentlist disqus replies reply respond discussion related recommended recommendations".split()
)
#: Of these, words that are headings of ordinary articles too: within an article they count only where links bear them out.
ORDINARY = frozenset("discussion related response".split())
OF_ARTICLE = frozenset("article entry post story".split())  # their header is the article's own
MARKS = frozenset("article main h1".split())
SEVERAL = 3  # paragraphs that make an element worth measuring in spite of its name
NAMED_WEIGHT = 0.5  # of the density of all within an element named like a part beside the article
KEPT = frozenset("html body main article".split())


class _Node:
    __slots__ = ("chars", "density", "items", "kids", "link_chars", "link_tags", "named", "parent", "spread", "tag", "tags", "talk", "unsure", "weight", "within")

    def __init__(self, tag: str, parent: _Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.items: list = []  # strings and nodes in page order
        self.kids: list[_Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.spread = 0.0
        self.weight = 1.0  # of the density: less within elements named like parts beside the article
        self.named = self.talk = self.within = False  # named like a part beside the article, like adverts or readers' talk; in an article or main element
        self.unsure = False  # named by an ordinary word within an article


def _words(value: str) -> set[str]:
    return {w.lower() for w in _NAME.findall(_CAMEL.sub(" ", value))}


def _beside(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool, bool]:
    """The element is no part of an article by its tag or as it is hidden; it is named like a part beside one; like adverts or
    readers' talk; only by words that head ordinary sections of an article.

    Paragraphs and headings of an article are named only by foreign words.
    """
    if tag in DROPPED or tag == "header" and not in_article:
        return True, False, False, False
    named = talk = unsure = False
    if not attrs:
        return False, False, False, False
    known = FOREIGN if in_article and tag in PROSE else BESIDE
    for m in _ATTR.finditer(attrs):
        key = m.group(1).lower()
        if key not in ("class", "id", "role", "style", "hidden", "aria-hidden"):
            continue
        value = (m.group(2) or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return tag not in KEPT, False, False, False
        if key == "style":
            if tag not in KEPT and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return True, False, False, False
            continue
        if key == "aria-hidden":
            continue
        words = _words(value)
        if in_article and words & ORDINARY and not words & (BESIDE - ORDINARY):
            unsure = True
            continue
        found = words & known
        named = named or tag not in KEPT and bool(found) and not (found == {"header"} and words & OF_ARTICLE)
        talk = talk or key in ("class", "id") and tag not in ("html", "body", "main") and bool(words & FOREIGN)
    return False, named, talk, unsure and not (named or talk)


class _Forms:
    """Some sites put the whole page into one form: what stands between a form's tags, from places found once per page."""

    def __init__(self, page: str) -> None:
        places = lambda pattern: [m.start() for m in re.finditer(pattern, page, re.IGNORECASE)]
        self.ends, self.articles, self.paragraphs = places("</form"), places("<(?:article|main)"), places("<p[ >]")

    def wraps_page(self, at: int) -> bool:
        k = bisect_left(self.ends, at)
        end = self.ends[k] if k < len(self.ends) else sys.maxsize
        inside = lambda found: bisect_left(found, end) - bisect_left(found, at)
        return inside(self.articles) > 0 or inside(self.paragraphs) >= SEVERAL


def parse(page: str) -> _Node:
    """Tree of what may be article text; dropped elements are left out whole."""
    root = _Node("#root", None)
    node, at, dropped = root, 0, 0
    open_tags: list[str] = []  # within a dropped element
    articles, any_named, forms = 0, False, None
    size = len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        text = page[at : m.start() if m else size]
        if text and not dropped:
            node.items.append(text)
        if not m:
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        tag, closing = name.lower(), bool(m.group(1) or m.group(4))
        attrs = m.group(3) or m.group(6) or ""
        if dropped:
            if closing:
                if tag in open_tags:
                    while open_tags.pop() != tag:
                        pass
                    dropped = len(open_tags)
                elif tag in ("body", "html"):
                    open_tags.clear()
                    dropped = 0
            elif tag not in VOID and not attrs.endswith("/"):
                if tag in RAW:
                    at = _after_raw(page, at, tag)
                else:
                    if open_tags and open_tags[-1] == "p" == tag or open_tags and open_tags[-1] == "li" == tag:
                        open_tags.pop()
                    open_tags.append(tag)
                    dropped = len(open_tags)
            continue
        if closing:
            up = node
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                while node is not up.parent:
                    articles -= node.tag in ("article", "main")
                    node = node.parent
            elif tag in ("p", "br"):
                node.items.append(_Node(tag, node))
            continue
        if tag in _P_ENDERS or tag in _SIBLINGS:
            node = _implied_end(node, tag)
        beside, named, talk, unsure = _beside(tag, attrs, articles > 0)
        if beside:
            if tag in RAW:
                at = _after_raw(page, at, tag)
            elif tag not in VOID and not attrs.endswith("/"):
                if tag == "form":
                    forms = forms or _Forms(page)
                    if forms.wraps_page(at):
                        continue
                open_tags.append(tag)
                dropped = 1
            if tag not in INLINE:
                node.items.append(_Node("br", node))
            continue
        child = _Node(tag, node)
        child.named, child.talk, child.unsure, child.within = named, talk, unsure, articles > 0
        any_named = any_named or named or talk or unsure
        node.items.append(child)
        node.kids.append(child)
        if tag not in VOID and not attrs.endswith("/"):
            node = child
            articles += tag in ("article", "main")
    if any_named:
        _prune(root)
    return root


def _prune(root: _Node) -> None:
    """Takes out elements named like parts beside the article that hold nothing of one.

    They stay, for density to decide, with an article or main element, with
    several paragraphs that aren't links, with most of the page's plain text (unless an
    article or main element with text stands elsewhere), or with the main heading
    within an article.  Adverts, teasers and readers' talk go wherever an article stands
    outside them, or, without one, where they hold at most a third of the plain text.
    Within an article a section that only an ordinary word names ("related-work") goes if it is mostly links.
    """
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(n.kids)
    plain: dict[_Node, int] = {}
    paragraphs: dict[_Node, int] = {}
    articles: dict[_Node, int] = {}  # characters in article elements, else in main elements
    holds: dict[_Node, set[str]] = {}
    for n in reversed(order):
        plain[n] = 0 if n.tag == "a" else sum(len(x.strip()) for x in n.items if isinstance(x, str)) + sum(plain[k] for k in n.kids)
        n.chars = sum(len(x.strip()) for x in n.items if isinstance(x, str)) + sum(k.chars for k in n.kids)
        paragraphs[n] = sum(paragraphs[k] + (k.tag == "p" and 0 < k.chars <= 2 * plain[k]) for k in n.kids)
        articles[n] = sum(articles[k] for k in n.kids)
        if n.tag == "article" or n.tag == "main" and not articles[n]:
            articles[n] = n.chars
        holds[n] = {t for k in n.kids for t in (*holds[k], k.tag) if t in MARKS and k.chars}
    marked = bool(holds[root] & {"article", "main"})
    gone: set[_Node] = set()
    for n in order:
        if n.unsure and 2 * plain[n] <= n.chars:
            gone.add(n)
            continue
        if n.parent is None or not n.named and not n.talk:
            continue
        outside = articles[root] - articles[n]
        if n.talk and (outside >= articles[n] if articles[n] else n.within or outside > 0 or 3 * plain[n] <= plain[root]):
            gone.add(n)
            continue
        if not n.named:
            continue
        if holds[n] & {"article", "main"} or paragraphs[n] >= SEVERAL or 2 * plain[n] > plain[root] and (n.within or not marked) or n.within and "h1" in holds[n]:
            continue
        gone.add(n)
    for above in {n.parent for n in gone}:
        above.items = [y for x in above.items for y in (([] if x.tag in INLINE else [_Node("br", above)]) if x in gone else [x])]
        above.kids = [k for k in above.kids if k not in gone]


def _after_raw(page: str, at: int, tag: str) -> int:
    m = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
    return m.end() if m else len(page)


def _implied_end(node: _Node, tag: str) -> _Node:
    ends, stop = _SIBLINGS.get(tag, ({"p"}, {"td", "th", "table", "button", "object", "article", "section", "div", "li", "body", "main"}))
    up: _Node | None = node
    while up is not None and up.tag not in stop:
        if up.tag in ends:
            return up.parent
        up = up.parent
    return node


def _measure(root: _Node) -> None:
    """Characters, tags and link shares of all subtrees, then densities and their sums."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(n.kids)
    for n in reversed(order):
        own = sum(len(x.strip()) for x in n.items if isinstance(x, str))
        n.chars = own + sum(k.chars for k in n.kids)
        n.tags = sum(k.tags + 1 for k in n.kids)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        else:
            n.link_chars, n.link_tags = sum(k.link_chars for k in n.kids), sum(k.link_tags for k in n.kids)
    share = root.link_chars / max(root.chars, 1)
    for n in order:
        if n.chars:
            tags, plain = max(n.tags, 1), max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * n.link_chars + share * n.chars + math.e)
            inside = n.chars / max(n.link_chars, 1) * tags / max(n.link_tags, 1)
            n.density = max(n.chars / tags * math.log(max(inside, 1.0001)) / math.log(max(base, 1.0001)), 0.0)
    for n in order:  # parents first
        for k in n.kids:
            k.weight = n.weight * NAMED_WEIGHT if k.named else n.weight
        n.spread = sum(k.density * k.weight for k in n.kids)


def _content(root: _Node) -> list:
    """The node with the largest density sum and dense parts beside its path, in page order."""
    _measure(root)
    best, stack = root, [root]
    while stack:
        n = stack.pop()
        if n.spread > best.spread:
            best = n
        stack.extend(reversed(n.kids))
    while best.tag in INLINE | HEADINGS | {"p"} and best.parent is not None:
        best = best.parent  # a paragraph full of markup is no article
    path = list(_upwards(best))
    threshold = min((n.density for n in path if n.density > 0), default=0.0)
    _without_link_lists(best, threshold)
    chosen: list = [best]
    for below, above in zip(path, path[1:], strict=False):
        inside = above.tag if above.tag in ("article", "main") else "main" if above.within else ""
        sides: tuple[list, list] = ([], [])
        right = 0
        for x in above.items:
            if x is below:
                right = 1
            elif isinstance(x, str):
                if x.strip() and (inside or _bare_density(x, root) >= threshold):
                    sides[right].append(x)
            elif x.tag == "br" or x.chars > 0 and _joins(x, inside, threshold, best):
                sides[right].append(x)
        chosen = [*sides[0], *chosen, *sides[1]]
    return chosen


def _without_link_lists(best: _Node, threshold: float) -> None:
    """Blocks below the threshold that hold several links and hardly anything else go; what an article element holds stays."""
    stack = [] if any(n.tag == "article" for n in _upwards(best)) else [best]
    while stack:
        n = stack.pop()
        lists = {k for k in n.kids if k.tag not in INLINE and k.link_tags > 1 and k.density < threshold and 10 * (k.chars - k.link_chars) <= k.chars}
        if lists and n.chars > sum(k.chars for k in lists):
            n.items = [_Node("br", n) if x in lists else x for x in n.items]
            n.kids = [k for k in n.kids if k not in lists]
        stack.extend(k for k in n.kids if k.tag != "article")


def _upwards(node: _Node | None) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.parent


def _joins(k: _Node, inside: str, threshold: float, best: _Node) -> bool:
    """A part beside the path belongs to the text.

    Links never do.  Within an article element all else does that isn't named like
    another part, within a main element headings and paragraphs; the density decides the rest.
    """
    if 2 * k.link_chars > k.chars:
        return False
    if inside and not k.named and (inside == "article" or k.tag in PROSE or k.tag in INLINE):
        return True
    return k.density * min(k.weight / best.weight, 1.0) >= threshold


def _bare_density(text: str, root: _Node) -> float:
    """Density of text that stands in no element of its own."""
    n = len(text.strip())
    return n * math.log(max(n, 1.0001)) / math.log(max(root.link_chars / max(root.chars, 1) * n + math.e, 1.0001))


def _blocks(node: _Node) -> Iterator[str]:
    """Pieces of text; None between two blocks."""
    stack: list = [iter([node])]
    ends: list[bool] = []
    while stack:
        item = next(stack[-1], None)
        if item is None:
            stack.pop()
            if ends and ends.pop():
                yield None
            continue
        if isinstance(item, str):
            yield item
            continue
        block = item.tag not in INLINE
        if block:
            yield None
        stack.append(iter(item.items))
        ends.append(block)


def extract(page: str | None) -> str:
    """Main text of a page."""
    if not page:
        return ""
    out: list[str] = []
    run: list[str] = []
    pieces = chain.from_iterable([x] if isinstance(x, str) else _blocks(x) for x in _content(parse(page)))
    for piece in chain(pieces, [None]):
        if piece is not None:
            run.append(piece)
        elif run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()
    return " ".join(out)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(ids: list, urls: list, pages: list) -> Iterator[tuple]:
        for page_id, url, page in zip(ids, urls, pages, strict=True):
            text = extract(page)
            yield page_id, url, text, len(text)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_rows(rows, ["page_id", "url", "html"], run, "page_id long, url string, text string, n_chars long",
                    ["page_id", "url", "text", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.int64()])

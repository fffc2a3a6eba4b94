"""Main text of web pages by composite text density.

A page is parsed to a tree (unclosed and implied end tags as browsers treat them). Elements that are
never content are left out: scripts, styles, forms, menus, footers, asides, what is hidden, and boxes whose
role, class or id is the name of such a part and nothing else (adverts, notices, sidebars, comments, ...; a name
with any other word in it, as related-work, says nothing). Inside an <article> or <main> headings and
sections are never judged by ids, which are made from titles. Text of formulas stays, without its annotations. For
every other node

    density = C/T * log(C/LC * T/LT) / log(log(C/(C-LC) * LC + LCb/Cb * C + e))

where C counts characters, T tags, LC characters in links, LT link tags, and b is the body (LC, LT, T and
C-LC count as 1 at least). The sum of a node's children's densities finds the maximum-sum subtree; the least
density on its path up to the body is the threshold. Other subtrees at or above it give their own maximum-sum
nodes, which join the main text where they continue it: in an <article> or <main> if it is in one (one with a fifth of the maximum
sum is preferred to any other node), or
beside the maximum-sum subtree with the same tag and class, or as the heading before it. What lies elsewhere is dense text
of other kinds, readers' comments above all. From the main text outside an <article> fall: lists and boxes
that are mostly links, everything from a heading that announces comments to the end of its box, and copyright
lines at the end.

Text: character references decoded; white space inside a block becomes one space; blocks are joined,
in page order, by two line feeds.

Defined cases: null and empty html, and pages without text, give the empty string; markup of any
length and depth is parsed in linear time; repeated rows are extracted row by row; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from . import runtime

SCHEMA = "page_id long, url string, text string, n_chars long"
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s>/]*)((?>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*))(?:>|\Z)",
    re.S,
)
#: One attribute: its whole name, and its value in one of three forms.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_JUDGED = frozenset("class id role hidden aria-hidden style".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame".split())
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
_SCOPE = frozenset("table td th caption html body button object article section main aside div".split())
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
_DROPPED = frozenset("head script style noscript template iframe object embed svg canvas audio video map nav footer aside form button select input textarea title dialog menu noembed noframes datalist annotation annotation-xml".split())
#: Parts of formulas: their text belongs to the block around them. Browsers don't show annotations.
_MATH = frozenset(
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom menclose maction msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd".split()
)
_UNSHOWN = frozenset("annotation annotation-xml".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Inside an article only these are judged by their id: others' ids are made from titles.
_BOXES = frozenset("div ul ol dl table center details".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
_BAD = re.compile(
    r"^(?:ads?|adv|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notices|notification\w*|alert|popup|modal|overlay|lightbox|newsletter|subscribe|subscription|signup|paywall"
    r"|sidebar|sidebars|rail|related|recommend\w*|share|sharing|social|comments?|commentlist|disqus|respond|replies|reply|discussion|menu|menus|nav|navbar|navigation|topnav|breadcrumbs?|pagination|pager|footer|foot|masthead|topbar|toolbar"
    r"|widget|widgets|login|search|searchbox|skip|copyright|disclaimer|trending|popular|outbrain|taboola|header)$"
)
#: Words that may stand beside such a name without giving it another sense.
_NEUTRAL = frozenset(
    "area aside bar block body bottom box btn button buttons card cards center col column container content desktop div feed fixed form global grid group holder icons inline inner item items js large layout left legal link links list lower"
    " main mobile module outer page panel primary region right row secondary section side site slot small sticky stories posts articles stack text top ui unit upper utility view wrap wrapper the by and to of in us new".split()
)
_GOOD = frozenset("article content main post entry story body text".split())
#: Names that hold though a word for the article stands beside them.
_SURE = re.compile(r"^(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|newsletter|sidebars?|related|recommend\w*|share|sharing|social|comments?|commentlist|replies|reply|nav|navigation|footer|pagination)$")
_COMMENTS = re.compile(r"\s*(?:\d+\s+(?:comments?|responses?|replies|kommentare?|comentarios?|commentaires?)|(?:reader |user |all |post a |add a |view )?comments?(?:\s*\(\d+\))?|leave a (?:reply|comment)|kommentare?|comentarios?|commentaires?)\s*:?\s*", re.I)
_RIGHTS = re.compile(r"\s*(?:©|\(c\)\s*\d|copyright\s*(?:©|\(c\)|\d{4}))|.*\b(?:all rights reserved|alle rechte vorbehalten|todos los derechos reservados|tous droits réservés)\b", re.I | re.S)
#: Of the maximum sum, the share from which the best <article> or <main> is preferred.
_MARKED = 0.2
#: Of the characters of a list or box, the share in links from which it is a menu; and its links at least.
_MENU_SHARE, _MENU_LINKS = 0.7, 3


class _Node:
    __slots__ = ("tag", "parent", "items", "host", "name")

    def __init__(self, tag: str, parent: _Node | None, name: str = ""):
        self.tag, self.parent, self.name = tag, parent, name
        self.items: list = []  # nodes and texts, in order
        #: The nearest <article> or <main> around it.
        self.host = None if parent is None else parent if parent.tag in ("article", "main") else parent.host


def _attributes(text: str) -> dict[str, str]:
    """The attributes that are judged, of the first of each name."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        if (name := name.lower()) in _JUDGED:
            out.setdefault(name, html.unescape(a or b or c).lower())
    return out


def _noise(name: str) -> bool:
    """Whether a class or id is the name of a part that is no content."""
    pieces = [p for p in re.split(r"[-_:.]+|(?<=[a-z])(?=\d)", name) if p and not p.isdigit()]
    if not pieces or pieces[0] in ("has", "with", "no", "without", "is"):
        return False
    bad = [p for p in pieces if _BAD.match(p)]
    if not bad or not all(p in _NEUTRAL or p in _GOOD or _BAD.match(p) for p in pieces):
        return False
    return pieces[0] in bad or not _GOOD.intersection(pieces) or any(_SURE.match(p) for p in bad)


def _names_noise(tag: str, found: dict[str, str], inside: bool) -> bool:
    """Whether role, class, id or state say that an element is no content."""
    if tag in ("html", "body", "main"):
        return False
    classes = found.get("class", "").split()
    if tag == "article":
        return any(re.split(r"[-_]+", c)[0] in ("comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo") for c in classes)
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if found.get("role") in _ROLES:
        return True
    if inside and tag in _HEADINGS:
        return False
    names = list(classes)
    if not inside or tag in _BOXES and "section" not in classes:
        names += found.get("id", "").split()
    return any(_noise(x) and not (inside and x.rstrip("s") in ("header", "discussion", "notice", "alert") and tag not in _BOXES) and not (inside and x == "header") for x in names)


class _Open:
    """The stack of open elements; places of each tag and kind, so that no step searches it."""

    def __init__(self, root: _Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.kinds: dict[str, list[int]] = {"scope": [], "block": [], "table": []}

    def _of(self, tag: str):
        yield self.places[tag]
        if tag in _SCOPE:
            yield self.kinds["scope"]
        if tag not in _INLINE:
            yield self.kinds["block"]
        if tag in ("table", "td", "th"):
            yield self.kinds["table"]

    def push(self, node: _Node) -> None:
        for x in self._of(node.tag):
            x.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Close the elements from place k on."""
        while len(self.nodes) > k:
            for x in self._of(self.nodes.pop().tag):
                x.pop()

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places[tag] else 0

    def kind(self, name: str) -> int:
        return self.kinds[name][-1] if self.kinds[name] else 0

    def end_p(self) -> None:
        if (k := self.last("p")) > self.kind("scope"):
            self.cut(k)

    def end_siblings(self, tag: str) -> None:
        same, until = _SIBLINGS[tag]
        edge = max(self.last(x) for x in until)
        found = [x[i] for t in same if (i := bisect_right(x := self.places[t], edge)) < len(x)]
        if found:
            self.cut(min(found))

    def end(self, tag: str) -> None:
        k = self.last(tag)
        edge = self.kind("block") if tag in _INLINE else self.kind("table") if tag in ("p", "li") else 0
        if k and k >= edge:
            self.cut(k)


def parse(page: str) -> _Node:
    """The tree of a page, without elements that are never content."""
    root = _Node("body", None)
    open_ = _Open(root)
    skipped: list[str] = []  # open elements from one that is left out on
    within: dict[str, int] = defaultdict(int)  # of each tag, how many of them

    def drop() -> str:
        tag = skipped.pop()
        within[tag] -= 1
        return tag

    def skip(tag: str) -> None:
        skipped.append(tag)
        within[tag] += 1

    at, end = 0, len(page)
    find = _TOKEN.search
    while at < end:
        m = find(page, at)
        if m is None:
            if not skipped:
                open_.nodes[-1].items.append(page[at:])
            break
        if m.start() > at and not skipped:
            open_.nodes[-1].items.append(page[at : m.start()])
        at = m.end()
        closing, opening = m[1], m[2]
        if opening:
            tag = opening.lower()
            if tag in _RAW:
                stop = re.compile(rf"</{tag}(?=[\s>/])", re.I).search(page, at)
                at = end if stop is None else stop.start()
                if stop is not None:
                    at = page.find(">", at) + 1 or end
                continue
            if tag in ("html", "body"):
                continue
            if skipped:
                if tag not in _VOID and not (m[3] or "").endswith("/"):
                    if tag in _SIBLINGS and skipped[-1] in _SIBLINGS[tag][0] and len(skipped) > 1:
                        drop()
                    if tag == "p" and skipped[-1] == "p" and len(skipped) > 1:
                        drop()
                    skip(tag)
                continue
            if tag in _MATH:
                continue
            if tag in _CLOSES_P:
                open_.end_p()
            if tag in _SIBLINGS:
                open_.end_siblings(tag)
            elif tag in _HEADINGS and open_.nodes[-1].tag in _HEADINGS and "hgroup" not in (tag, open_.nodes[-1].tag):
                open_.cut(len(open_.nodes) - 1)
            node = open_.nodes[-1]
            inside = node.host is not None or node.tag in ("article", "main")
            found = _attributes(m[3]) if m[3] else {}
            if tag in _DROPPED or tag == "header" and not inside or found and _names_noise(tag, found, inside):
                if tag not in _UNSHOWN:
                    node.items.append(None)  # a boundary
                if tag not in _VOID:
                    skip(tag)
                continue
            child = _Node(tag, node, found.get("class", ""))
            node.items.append(child)
            if tag not in _VOID:
                open_.push(child)
        elif closing:
            tag = closing.lower()
            if skipped:
                if within[tag]:
                    while drop() != tag:
                        pass
                    continue
                # the end of an element around it also ends what is left out
                if tag in ("p", "b", "i", "a", "span", "em", "strong", "li") or not open_.last(tag):
                    continue
                while skipped:
                    drop()
            open_.end(tag)
    return root


def _measure(root: _Node) -> list[tuple[_Node, int, int, int, int]]:
    """Of each node, children first: characters, tags, characters in links, link tags."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(x for x in n.items if isinstance(x, _Node))
    counts: dict[int, list[int]] = {}
    out = []
    for n in reversed(order):
        c = t = lc = lt = 0
        for x in n.items:
            if isinstance(x, _Node):
                a = counts[id(x)]
                c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3]
            elif x:
                c += len(x) - x.count(" ") if x.isspace() else len(x.strip())
        if n.tag == "a":
            lc, lt = c, lt + 1
        counts[id(n)] = [c, t, lc, lt]
        out.append((n, c, t, lc, lt))
    return out


def _chosen(root: _Node) -> tuple[list[_Node], set[int]]:
    """The subtrees that hold the main text, in page order; and parts of them that are menus."""
    measured = _measure(root)
    total, links = max(measured[-1][1], 1), measured[-1][3]
    density: dict[int, float] = {}
    menus: set[int] = set()
    for n, c, t, lc, lt in measured:
        if not c:
            density[id(n)] = 0.0
            continue
        if n.tag not in _INLINE and lt >= _MENU_LINKS and lc >= _MENU_SHARE * c and n.host is None and n is not root:
            menus.add(id(n))
        t, lc_, lt_ = max(t, 1), max(lc, 1), max(lt, 1)
        base = math.log(c / max(c - lc, 1) * lc_ + links / total * c + math.e)
        density[id(n)] = c / t * math.log(max(c / lc_ * t / lt_, 1.0)) / math.log(base)
    sums: dict[int, float] = {}
    best_in: dict[int, _Node] = {}
    for n, *_ in measured:
        children = [x for x in n.items if isinstance(x, _Node)]
        loose = sum(len(x.strip()) for x in n.items if isinstance(x, str))
        sums[id(n)] = sum(density[id(x)] for x in children) + (loose if not children else 0)
        best = n
        for x in children:
            if sums[id(best_in[id(x)])] > sums[id(best)]:
                best = best_in[id(x)]
        best_in[id(n)] = best
    top = best_in[id(root)]
    while top.tag in _INLINE and top.parent is not None:
        top = top.parent
    threshold, up = density[id(top)], top
    while up is not None:
        threshold, up = min(threshold, density[id(up)]), up.parent
    whole = lambda n: n if n.tag in ("article", "main") else n.host or n
    marked = max((n for n, *_ in measured if n.tag in ("article", "main")), key=lambda n: sums[id(best_in[id(n)])], default=None)
    if marked is not None and whole(top).tag not in ("article", "main") and sums[id(best_in[id(marked)])] >= _MARKED * sums[id(top)]:
        top = marked
    top = whole(top)
    keep = {id(top)}
    hosted = top.tag in ("article", "main")
    for n, *_ in measured:
        if n.tag not in _INLINE and density[id(n)] >= threshold and density[id(n)] > 0:
            near = whole(best_in[id(n)])
            if hosted and near.tag in ("article", "main") or not hosted and near.parent is top.parent and (near.tag, near.name) == (top.tag, top.name):
                keep.add(id(near))
    # The heading right before the main text, at any height.
    n = top
    while n.parent is not None:
        place = next(i for i, x in enumerate(n.parent.items) if x is n)
        before = next((x for x in reversed(n.parent.items[:place]) if isinstance(x, _Node) and (x.items or x.tag in _HEADINGS) or isinstance(x, str) and x.strip()), None)
        if isinstance(before, _Node):
            if before.tag in ("h1", "h2") and id(before) not in menus:
                keep.add(id(before))
            break
        if before is not None:
            break
        n = n.parent
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if id(n) in keep:
            out.append(n)
        else:
            stack.extend(x for x in reversed(n.items) if isinstance(x, _Node))
    return out, menus


def _words(n: _Node, most: int = 60) -> str:
    """The text of a node up to about `most` characters."""
    out, size, stack = [], 0, [n]
    while stack and size <= most:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            size += len(x)
        elif x is not None:
            stack.extend(reversed(x.items))
    return html.unescape("".join(out))


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    blocks: list[tuple[str, bool]] = []  # text, whether in an <article> or <main>
    run: list[str] = []

    def flush(inside: bool) -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                blocks.append((text, inside))
            run.clear()

    chosen, menus = _chosen(parse(page))
    for top in chosen:
        inside = top.host is not None or top.tag in ("article", "main")
        stack: list = [iter(top.items)]
        tags = [top.tag]
        while stack:
            x = next(stack[-1], 0)
            if x == 0 and not isinstance(x, str):
                stack.pop()
                if tags.pop() not in _INLINE:
                    flush(inside)
            elif isinstance(x, _Node):
                if x.tag in ("br", "img", "wbr"):
                    if x.tag == "br":
                        run.append(" ")
                    continue
                if x.tag not in _INLINE:
                    flush(inside)
                if not inside and id(x) in menus:
                    continue
                if not inside and x.tag in _HEADINGS and _COMMENTS.fullmatch(_words(x)):
                    stack[-1] = iter(())  # the rest of the box
                    continue
                stack.append(iter(x.items))
                tags.append(x.tag)
            elif x is None:
                flush(inside)
            else:
                run.append(x)
        flush(inside)
    while blocks and not blocks[-1][1] and len(blocks[-1][0]) < 300 and _RIGHTS.match(blocks[-1][0]):
        blocks.pop()
    return "\n\n".join(text for text, _ in blocks)


def text_batches(batches):
    for batch in batches:
        texts = [extract(x) for x in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of all pages (page_id, url, html)."""
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html")
    return rows.mapInArrow(runtime.shipped("quillmill.llm.html_text:text_batches"), SCHEMA)

"""Main text of web pages by tree scoring.

A page is parsed into a light tree of block elements. Subtrees that are never article
text (scripts, styles, forms, navigation, hidden elements) are left out, and so are those
whose class, id or role names them as menu, advert, comments and the like. A class or id
does so as a whole: it is such a word (``sidebar``), or it is put together of such words
and of words for a place or a box alone (``site-footer``, ``comment-list``), so that
``no-sidebar`` or ``social-policy`` is an ordinary name. An element so named stays
nevertheless if no article or main element is outside of such elements and it holds one,
or, with a name put together, more than half of the text. Every text block passes points for
its length and commas to its ancestors, less with each level; a container's points are
discounted by the share of its text that lies in links. The container with most points
is kept, with those siblings that have a fair share of points and with the headings
directly before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SIBLING_SHARE = 0.2
LINKS_AT_MOST = 0.6  # lists and boxes within the container, but not in an article element, with a larger share of link text go
LINK_BOX = 3  # if they have so many links

#: Element names of HTML, and words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe svg math object canvas video audio dialog menu title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption script style noscript template button select option textarea iframe svg math object canvas video audio title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre li dt dd td th blockquote figcaption caption summary address".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption option script style template noscript title head html body svg math object canvas video audio iframe button select textarea".split())
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section main aside nav div body html".split())
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist respond replies cookie cookies consent disqus footer foot header masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion promoted related recommended share sharing shares sidebar sidenav social sponsor sponsored subscribe subscription toolbar widget widgets gdpr login signup skip topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

TITLES = frozenset("header masthead banner".split())  # not furniture within an article
PLACES = frozenset("site page main left right top bottom upper lower primary secondary global post posts article articles story stories reader readers user users section sections area areas box boxes block blocks bar bars list lists item items container containers wrapper wrap inner outer holder panel panes pane region group row rows col cols column columns slot unit space link links form button buttons content body text title icons icon message feed sticky fixed floating mobile desktop inline block x the".split())

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
NAMED, COMPOSED, GONE = 2, 1, 3  # how an element is marked; 0 if it is not
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _named(name: str, inside: bool) -> int:
    """How a class or id marks an element; ``inside`` an article its header is not furniture."""
    words = [w.lower() for w in _PARTS.findall(name)]
    known = [w for w in words if w in FURNITURE and not (inside and w in TITLES)]
    if not known or any(w not in FURNITURE and w not in PLACES and not w.isdigit() for w in words) or inside and len(known) < sum(w in FURNITURE for w in words):
        return 0
    return NAMED if len(words) == len(known) else COMPOSED


def _furniture(attrs: str, tag: str, inside: bool) -> int:
    """Whether an element's attributes mark it as page furniture or as hidden."""
    found = 0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main"):
                found = max([found, *(_named(x, inside) for x in value.split())])
        elif name == "role":
            if value.lower() in ROLES:
                found = max(found, NAMED)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value.lower()):
            return GONE
    return found


class _Tree:
    """Elements as parallel lists (a parent comes before its children) and text blocks in page order."""

    def __init__(self):
        self.tag, self.parent, self.dropped, self.mark, self.inside = ["#root"], [-1], [False], [0], [False]
        self.blocks: list[tuple[int, str, int, int]] = []  # element, text, characters in links, links
        self.open = [0]
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.link_from = -1
        self.in_article = 0

    def text(self, raw: str) -> None:
        if not self.dropped[self.open[-1]]:
            if self.link_from >= 0:
                self.linked += len(raw)
            self.parts.append(raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.open[-1], text, min(self.linked, len(text)), self.links))
            self.parts, self.linked, self.links = [], 0, 0

    def push(self, tag: str, attrs: str) -> None:
        self.flush()
        top = self.open[-1]
        mark = _furniture(attrs, tag, self.in_article > 0) if attrs else 0
        self.tag.append(tag)
        self.parent.append(top)
        self.dropped.append(self.dropped[top] or tag in DROPPED or tag == "header" and not self.in_article or mark == GONE)
        self.mark.append(mark)
        self.inside.append(self.inside[top] or tag == "article")
        self.open.append(len(self.tag) - 1)
        self.in_article += tag in ("article", "main")
        self.link_from = -1

    def pop_to(self, depth: int) -> None:
        self.flush()
        for node in self.open[depth:]:
            self.in_article -= self.tag[node] in ("article", "main")
        del self.open[depth:]

    def close(self, names: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        """Close the nearest open element of these names, unless one of ``within`` lies between."""
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in names:
                self.pop_to(depth)
                return
            if tag in within:
                return


def _parse(html: str) -> _Tree:
    tree, at = _Tree(), 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            if at < len(html):
                tree.text(unescape(html[at:]))
            break
        if m.start() > at:
            tree.text(unescape(html[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"]:
                tree.text(m["cdata"])
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                tree.link_from = -1
            elif name in BLOCKS:
                if name == "p":
                    tree.close(("p",), SCOPES)
                else:
                    tree.close((name,))
                tree.link_from = -1
            continue
        if name == "a":
            tree.link_from = len(tree.parts)
            tree.links += 1
        elif name == "br":
            tree.text(" ")
        elif name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            at = stop.start() if stop else len(html)
            if stop:
                at = html.find(">", at) + 1 or len(html)
        elif name in VOID:
            if name == "hr":
                tree.flush()
        elif name in BLOCKS:
            if name in CLOSES_P:
                tree.close(("p",), SCOPES)
            if name in OWN_KIND:
                tree.close(OWN_KIND[name], frozenset(("ul", "ol", "dl", "table")))
            if name in HEADINGS and tree.tag[tree.open[-1]] in HEADINGS:
                tree.close(tuple(HEADINGS))
            tree.push(name, m["attrs"])
            if m["attrs"].endswith("/") and name in ("svg", "iframe", "script"):
                tree.pop_to(len(tree.open) - 1)
    tree.flush()
    return tree


def _without_furniture(tree: _Tree) -> None:
    """Take away the text of elements whose name marks them as furniture, unless they hold the article."""
    n = len(tree.tag)
    if not any(tree.mark):
        return
    chars, holds, within = [0] * n, [t in ("article", "main") and not d for t, d in zip(tree.tag, tree.dropped, strict=True)], [False] * n
    for node, text, _, _ in tree.blocks:
        chars[node] += len(text)
    for k in range(1, n):
        within[k] = within[tree.parent[k]] or tree.mark[k] > 0
    outside = any(h and not w for h, w in zip(holds, within, strict=True))
    for k in range(n - 1, 0, -1):
        up = tree.parent[k]
        chars[up] += chars[k]
        holds[up] = holds[up] or holds[k]
    for k in range(1, n):
        stays = not outside and (holds[k] or tree.mark[k] == COMPOSED and 2 * chars[k] > chars[0])
        tree.dropped[k] = tree.dropped[k] or tree.dropped[tree.parent[k]] or tree.mark[k] > 0 and not stays
    tree.blocks = [b for b in tree.blocks if not tree.dropped[b[0]]]


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order, joined by line feeds; empty if there is none."""
    tree = _parse(html or "")
    _without_furniture(tree)
    n = len(tree.tag)
    points, chars, linked, links = [0.0] * n, [0] * n, [0] * n, [0] * n
    for node, text, in_link, count in tree.blocks:
        chars[node] += len(text)
        linked[node] += in_link
        links[node] += count
        share = (1 + text.count(",") + text.count("،") + text.count("、") + text.count("，") + len(text) / 100) * (1 - in_link / len(text))
        up, level = (tree.parent[node] if tree.tag[node] in PARAGRAPHS else node), 1
        while up > 0 and level <= 4:
            points[up] += share / level
            up, level = tree.parent[up], level + 1
        if up == 0 and level == 1:
            points[0] += share
    for node in range(n - 1, 0, -1):
        up = tree.parent[node]
        chars[up] += chars[node]
        linked[up] += linked[node]
        links[up] += links[node]
    score = [p * (1 - linked[k] / chars[k]) if chars[k] else 0.0 for k, p in enumerate(points)]
    if not tree.blocks:
        return ""
    best = max(range(n), key=lambda k: (score[k], -k))
    kept = [False] * n
    kept[best] = True
    if best:
        above = tree.parent[best]
        least = SIBLING_SHARE * score[best]
        siblings = [k for k in range(above + 1, n) if tree.parent[k] == above]
        for at, k in enumerate(siblings):
            dense = linked[k] > 0.25 * chars[k]
            if k != best and not dense and (score[k] >= least or tree.tag[k] == "p" and chars[k] >= 80):
                kept[k] = True
        for k in reversed(siblings[: siblings.index(best)]):
            if tree.tag[k] not in HEADINGS:
                break
            kept[k] = True
    for k in range(1, n):
        if not kept[k] and kept[tree.parent[k]]:
            box = not tree.inside[k] and tree.tag[k] in ("ul", "ol", "div", "section", "table", "dl") and links[k] >= LINK_BOX and linked[k] > LINKS_AT_MOST * chars[k]
            kept[k] = not box
    return "\n".join(text for node, text, _, _ in tree.blocks if kept[node])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Needs page_id, url, html; other columns are left out. A null or empty html, or a page
    without text, gives an empty text. Unclosed and misnested elements are closed as
    browsers would in the usual cases; a page cut off anywhere keeps what it has. Repeated
    rows each get a row.
    """
    small_batches(pages)
    kinds = [pages.schema["page_id"].dataType.simpleString(), pages.schema["url"].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")

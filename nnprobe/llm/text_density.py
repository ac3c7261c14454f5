"""Main text of web pages by composite text density (operator 6).

A page is parsed into a DOM.  Scripts, styles, controls and hidden parts are
never text.  Menus, headers, footers, side bars, notices, adverts, forms and
reader comments are named by element, role and class words; such a subtree is
cut unless the page's text lies in it: one that holds an article or main
element of its own stays, a form, header or class-named subtree with more than
half of the page's unlinked text stays, and a name that is only in part such a
word ("related-work", "share-price") is cut where the subtree is mostly links.
Every node left gets its link-adjusted characters per tag; the sum over a
node's block children is its density sum.  The node with the largest sum (the
first of equals) is the main subtree, widened to the article or main element
around it.  The least density on its path to the body is the threshold: a
subtree beside the path that reaches it belongs to the text too, and so does a
paragraph, heading, list or table there with few links.  Nothing else inside a
chosen subtree is dropped.

Text: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined by one newline in page order.

Edge cases: null and empty pages give an empty text; a page without body or
tags is its own body; unclosed and misnested tags are closed as browsers do
for paragraphs, list items and table cells; a comment, declaration or tag that
never ends reaches to the end of the page; nesting of any depth and very long
pages take linear time, closed or not; repeated rows repeat; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and words of classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("head script style noscript template button select textarea input iframe svg canvas object audio video map".split())
NAMED = frozenset("nav header footer aside form menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr img ruby rt rp".split())
IN_HEAD = frozenset("title meta link base script style noscript template".split())
KEEP = frozenset("html body main".split())
# Words that name boilerplate whatever stands beside them, words that do so alone, and words that say nothing.
SURE = frozenset("ads adv advert adverts advertisement advertisements advertising adsense sponsored nav navbar navigation submenu "
                 "breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer masthead topbar toolbar cookie cookies "
                 "gdpr popup newsletter subscribe comment comments disqus".split())
WORDS = SURE | frozenset("ad banner sponsor promo promotion menu header consent notice notices alert modal overlay subscription "
                         "signup login share sharing social respond related recommended widget widgets skip search".split())
NEUTRAL = frozenset("area bar block body bottom bottoms box btn button buttons center col column container content cta fixed form global "
                    "group holder icon icons inline inner js large left link links list item items layer main mobile module outer page "
                    "panel post posts primary right row secondary section segment site slot small space sticky text title top unit "
                    "user wrap wrapper zone".split())
ARTICLE_WORDS = frozenset("comment comments ad ads advert advertisement sponsored promo related recommended".split())
NEVER_TEXT = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsored comment comments disqus".split())
HAS = frozenset("has with no without".split())          # "has-sidebar" is no side bar
TITLES = frozenset("article post entry content section".split())    # "post-header" holds a title
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
MAX_LINKED = 1 / 3
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                  "toolbar".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th"), "tfoot": ("tr", "td", "th")}
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"),
         "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
_WORD = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_COMMENT_END = re.compile("--!?>")
_ATTR = re.compile(r"""[\s/]*(?:>|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]*)))?)""")
RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noframes")}
NOT_CUT, SOFT, FIRM, HARD = range(4)         # how surely a subtree is boilerplate


def _boilerplate(tag: str, attrs: list) -> int:
    """HARD: never text.  FIRM: text only if an article lies in it.  SOFT: or
    if most of the page's text does."""
    if tag in DROP:
        return HARD
    if tag in KEEP:
        return NOT_CUT
    found = NOT_CUT
    if tag in NAMED:
        found = SOFT if tag in ("form", "header") else FIRM
    for name, value in attrs:
        value = value.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return HARD
        if name == "role" and value.strip() in ROLES:
            found = max(found, FIRM)
        if name in ("class", "id"):
            for one in value.split():
                words = set(_WORD.split(one)) - {""}
                hit = words & (ARTICLE_WORDS if tag == "article" else WORDS)
                if "header" in hit and words & TITLES:
                    hit -= {"header"}
                if hit and not words & HAS:
                    found = max(found, FIRM if hit & NEVER_TEXT else SOFT)
    return found


def _only_in_part(tag: str, attrs: list) -> bool:
    """True if nothing but class words beside other words name the subtree."""
    if tag in NAMED or any(name == "role" and value.lower().strip() in ROLES for name, value in attrs):
        return False
    for name, value in attrs:
        if name in ("class", "id"):
            for one in value.lower().split():
                words = set(_WORD.split(one)) - {""}
                if words & WORDS and not words & HAS and (words & SURE or all(w in WORDS or w in NEUTRAL or w.isdigit() for w in words)):
                    return False
    return True


class _Page:
    """Nodes in page order (a child comes after its parent) and text pieces."""

    def __init__(self):
        self.tag, self.parent, self.named, self.partly = ["#page"], [-1], [NOT_CUT], [False]
        self.stack, self.opened = [0], {}            # open nodes; per tag the depths it is open at
        self.cut = 0                 # depth of the stack at the subtree that is never text, or 0
        self.block, self.pieces = 0, []

    def feed(self, html: str) -> None:
        """One pass from left to right; every character is looked at a bounded number of times."""
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.text(unescape(html[at:lt]))
            at = lt + 1
            nxt = html[at:at + 1]
            if nxt == "!" or nxt == "?":
                if html.startswith("--", at + 1):
                    end = _COMMENT_END.search(html, at + 1)
                    at = end.end() if end else n
                else:
                    at = html.find(">", at) + 1 or n
            elif nxt == "/":
                name = _NAME.match(html, at + 1)
                if name:
                    _, at, whole = self._attrs(html, name.end())
                    if whole:
                        self.end(name.group().lower())
                else:
                    at = html.find(">", at) + 1 or n
            elif name := _NAME.match(html, at):
                attrs, at, whole = self._attrs(html, name.end())
                if not whole:
                    continue
                tag = name.group().lower()
                self.start(tag, attrs)
                if tag in RAW:
                    end = RAW[tag].search(html, at)
                    stop = end.start() if end else n
                    if stop > at and tag in ("textarea", "title", "noscript"):
                        self.text(unescape(html[at:stop]))
                    at = stop
            elif lt < n:
                self.text("<")

    @staticmethod
    def _attrs(html: str, at: int):
        """Attributes from ``at``, the place behind the tag, and whether it ends at all."""
        attrs = []
        while m := _ATTR.match(html, at):
            at = m.end()
            if m.group(1) is None:
                return attrs, at, True
            attrs.append((m.group(1).lower(), unescape(m.group(2) or m.group(3) or m.group(4) or "")))
        # an open quote or the end of the page
        return attrs, len(html), False

    def _pop(self):
        depth = len(self.stack) - 1
        tag = self.tag[self.stack.pop()]
        self.opened[tag].pop()
        if self.cut and depth <= self.cut:
            self.cut = 0
        if tag not in INLINE:
            self.block += 1

    def _innermost(self, tags: tuple) -> int:
        return max((self.opened[t][-1] for t in tags if self.opened.get(t)), default=0)

    def _close(self, tags: tuple, scope: tuple) -> None:
        """Close the innermost open element of ``tags`` unless one of ``scope`` lies inside it."""
        depth = self._innermost(tags)
        if depth > self._innermost(scope):
            while len(self.stack) > depth:
                self._pop()

    def start(self, tag, attrs):
        if self.opened.get("head") and tag not in IN_HEAD and tag != "head":
            self._close(("head",), ())
        if tag in CLOSES:
            for _ in CLOSES[tag]:
                self._close(CLOSES[tag], SCOPE[tag])
        elif tag not in INLINE and tag not in VOID or tag == "hr":
            self._close(("p",), ("div", "td", "th", "li", "article", "section", "blockquote", "table", "body"))
        if tag not in INLINE and tag != "br":
            self.block += 1
        if tag == "br":
            self.text(" ")
        if self.cut and tag in VOID:
            return
        named = NOT_CUT if self.cut else _boilerplate(tag, attrs)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.named.append(named)
        self.partly.append(named == SOFT and _only_in_part(tag, attrs))
        if tag in VOID:
            return
        self.opened.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.tag) - 1)
        if named == HARD:
            self.cut = len(self.stack) - 1

    def end(self, tag):
        if tag not in INLINE and tag != "br":
            self.block += 1
        if self.opened.get(tag):
            while self.tag[self.stack[-1]] != tag:
                self._pop()
            self._pop()

    def text(self, data):
        if not self.cut:
            self.pieces.append((self.stack[-1], self.block, data))

    def boilerplate(self, chars: list, linked: list) -> list[bool]:
        """For every node whether it lies in a cut subtree, from the characters
        and linked characters of the subtrees."""
        n = len(self.tag)
        holds = [False] * n          # an article or main that is not named itself
        for i in range(n - 1, 0, -1):
            own = self.tag[i] == "main" or self.tag[i] == "article" and self.named[i] == NOT_CUT
            holds[self.parent[i]] |= own or holds[i] and self.named[i] < HARD
        whole = chars[0] - linked[0]
        cut = [False] * n
        for i in range(1, n):
            named = self.named[i]
            if cut[self.parent[i]] or named == HARD:
                cut[i] = True
            elif named != NOT_CUT and not holds[i]:
                most = 2 * (chars[i] - linked[i]) > whole
                if self.partly[i]:
                    cut[i] = linked[i] > MAX_LINKED * chars[i] or not chars[i]
                else:
                    cut[i] = named == FIRM or not most
        return cut


def _density(c: int, t: int, lc: int, lt: int, body_share: float) -> float:
    """Characters per tag, lowered by the share of linked characters and tags."""
    if not c:
        return 0.0
    t, lt, links, rest = max(t, 1), max(lt, 1), max(lc, 1), max(c - lc, 1)
    base = math.log(c / rest * links + body_share * c + math.e)
    return c / t * math.log(max(c / links * t / lt, 1.0)) / math.log(base)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    n = len(page.tag)
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    size = [len(" ".join(data.split())) for _, _, data in page.pieces]

    def summed(cut):
        """Characters, tags, linked characters and links of every subtree without what is cut."""
        chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
        for (node, _, _), c in zip(page.pieces, size, strict=True):
            if not cut[node]:
                chars[node] += c
                linked[node] += c * in_link[node]
        for i in range(n - 1, 0, -1):
            if not cut[i]:
                p = page.parent[i]
                chars[p] += chars[i]
                linked[p] += linked[i]
                tags[p] += tags[i] + 1
                links[p] += links[i] + (page.tag[i] == "a")
        return chars, tags, linked, links

    chars, _, linked, _ = summed([False] * n)
    cut = page.boilerplate(chars, linked)
    chars, tags, linked, links = summed(cut)
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    share = linked[body] / max(chars[body], 1)
    density = [_density(chars[i], tags[i], linked[i], links[i], share) for i in range(n)]
    holder = list(range(n))          # nearest node that is no inline element
    for i in range(1, n):
        if page.tag[i] in INLINE or page.tag[i] in VOID:
            holder[i] = holder[page.parent[i]]
    total = [0.0] * n
    for i in range(1, n):
        if holder[i] == i:
            total[holder[page.parent[i]]] += density[i]
    under = [False] * n
    under[body] = True
    for i in range(body + 1, n):
        under[i] = under[page.parent[i]]
    best = max((i for i in range(n) if under[i] and holder[i] == i), key=lambda i: (total[i], -i), default=body)
    if total[best] <= 0:
        best = body
    path, top, i = {best}, best, best
    while i != body:
        i = page.parent[i]
        path.add(i)
        if page.tag[i] in ("article", "main"):
            top = i                   # the author's own bounds of the text
    least = min(density[i] for i in path)
    while best != top:
        path.discard(best)
        best = page.parent[best]
    chosen = [False] * n
    chosen[best] = True
    for i in range(body, n):
        if not under[i] or i in path:
            continue
        p = page.parent[i]
        chosen[i] = chosen[p] or (p in path and (density[i] >= least > 0 or page.tag[i] in TEXT_BLOCKS
                                                 and linked[i] <= MAX_LINKED * chars[i]))
    blocks: list[tuple[int, list]] = []
    for node, block, data in page.pieces:
        if not cut[node] and (chosen[node] or node in path and node != body):
            if not blocks or blocks[-1][0] != block:
                blocks.append((block, []))
            blocks[-1][1].append(data)
    lines = (" ".join("".join(parts).split()) for _, parts in blocks)
    return "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars (code points) of every page."""
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = rows.drop("_html").schema.add("text", "string").add("n_chars", "long")
    names = schema.names

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()),
                                              pa.array(list(map(len, texts)), pa.int64())], names=names)

    return rows.mapInArrow(run, schema)

"""Main text of web pages by composite text density.

A page is parsed into a tree without the parts that are never article text (scripts, menus, forms and the like); an
article's own header and formulas stay.
Every node gets its characters per tag, lowered by the share of link text. The subtree whose children's densities
have the largest sum holds the text; the least density on its path to the body is the threshold that other
subtrees must reach to be text as well. If the subtree lies within an article or main element, that element is taken
whole, and the threshold decides on what lies beside it.

Parts are left out by element name, by a hidden attribute, or by a role, class or id that names a part beside the
article (each word of a whole class or id; articles and mains only by role). A named part with more than half of the
page's characters stays, and density decides, unless an article or main with text lies beside it (as with comments
below a short article).

Defined results: null or empty html and pages without text give the empty text; broken markup is read to its end;
equal rows give equal rows; an empty table gives an empty table; other columns are ignored. Very deep or long
pages are read whole, without recursion.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame

from .common import column_of, map_text

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr img ruby rb rt rp "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom mfenced menclose msub msup msubsup munder "
    "mover munderover mmultiscripts mprescripts semantics annotation annotation-xml".split()
)
NEVER_TEXT = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript template head nav header footer aside form button "
    "select option datalist input dialog menu svg canvas audio video object annotation annotation-xml".split()
)
#: An open element of the first kind ends when one of the second kind begins.
ENDS = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
SCOPES = frozenset("table ul ol dl select body html div article section main td th".split())
#: Words of which a whole class or id consists, and roles, of parts that are not article text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription promo promotion share sharing social "
    "sidebar related recommended breadcrumb breadcrumbs pagination pager menu nav navbar navigation footer header "
    "masthead comment comments respond reply replies disqus discussion widget toolbar skip".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
CONTAINERS = frozenset({"article", "main"})

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_LOOKED_AT = re.compile("class|id|role|hidden", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_BETWEEN = re.compile(r"[-_:0-9]+")


class Tree:
    """Nodes in page order; node 0 is the body. ``pieces`` holds (node, text) and (node, None) for block borders."""

    def __init__(self, page: str):
        self.parent, self.tag, self.dropped, self.named = [-1], ["body"], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []
        self._read(page)
        self._drop_named()

    def _read(self, page: str) -> None:
        open_ = [0]
        at = 0
        while at < len(page):
            m = _TOKEN.search(page, at)
            end = m.start() if m else len(page)
            if end > at:
                self.pieces.append((open_[-1], page[at:end]))
            if not m:
                return
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(open_, name)
                continue
            if name in ("html", "body"):
                continue
            self._imply(open_, name)
            node = len(self.parent)
            above = open_[-1]
            self.parent.append(above)
            self.tag.append(name)
            hidden, named = self._aside(m[3] or m[6] or "", name)
            own_header = name == "header" and any(self.tag[n] == "article" for n in open_)
            self.dropped.append(self.dropped[above] or name in NEVER_TEXT and not own_header or hidden)
            self.named.append(named)
            if name not in INLINE:
                self.pieces.append((above, None))
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                inner = stop.start() if stop else len(page)
                at = page.find(">", inner) + 1 if stop and page.find(">", inner) >= 0 else len(page)
            elif name not in VOID:
                open_.append(node)

    def _close(self, open_: list[int], name: str) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if self.tag[open_[k]] == name:
                if name not in INLINE:
                    self.pieces.append((open_[k], None))
                elif any(self.tag[n] not in INLINE for n in open_[k + 1 :]):
                    return  # an inline element does not end blocks opened within it
                del open_[k:]
                return
            if self.tag[open_[k]] in SCOPES and name in INLINE | {"p"}:
                return

    def _imply(self, open_: list[int], name: str) -> None:
        """End what the beginning of this element ends."""
        if name in INLINE or name == "br":
            return
        for k in range(len(open_) - 1, 0, -1):
            tag = self.tag[open_[k]]
            if name in ENDS.get(tag, ()) or tag == "p":
                self.pieces.append((open_[k], None))
                del open_[k:]
                return
            if tag in SCOPES:
                return

    def _aside(self, attributes: str, name: str) -> tuple[bool, bool]:
        """Whether an element is hidden, and whether its class, id or role names a part that is not article text."""
        if not _LOOKED_AT.search(attributes):
            return False, False
        values: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes):
            values.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        named = bool(ASIDE_ROLES.intersection(values.get("role", "").split()[:1]))
        if name not in CONTAINERS:
            for token in f"{values.get('class', '')} {values.get('id', '')}".split():
                words = [w for w in _BETWEEN.split(token) if w]
                named = named or bool(words) and ASIDE_WORDS.issuperset(words)
        return "hidden" in values, named

    def _drop_named(self) -> None:
        """Drop the named parts and what is in them, but for those that hold most of the page's text while no
        article or main with text begins beside them."""
        if not any(self.named):
            return
        n = len(self.parent)
        chars = [0] * n
        for node, text in self.pieces:
            if text is not None and not self.dropped[node]:
                chars[node] += len(" ".join(text.split()))
        inside, around = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            inside[i] += int(self.tag[i] in CONTAINERS and chars[i] > 0)
            inside[self.parent[i]] += inside[i]
        for i in range(1, n):
            up = self.parent[i]
            around[i] = around[up] + int(self.tag[up] in CONTAINERS and chars[up] > 0)
            stays = 2 * chars[i] > chars[0] and inside[0] == inside[i] + around[i]
            self.dropped[i] = self.dropped[i] or self.dropped[up] or self.named[i] and not stays


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """Composite text density of every node, and the sum of its children's."""
    n = len(tree.parent)
    chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    inside = [False] * n
    for i in range(1, n):
        inside[i] = inside[tree.parent[i]] or tree.tag[i] == "a"
        tags[i] = 1
        links[i] = int(tree.tag[i] == "a")
    for node, text in tree.pieces:
        if text is not None and not tree.dropped[node]:
            c = len(" ".join(text.split()))
            chars[node] += c
            if inside[node]:
                linked[node] += c
    for i in range(n - 1, 0, -1):
        if not tree.dropped[i]:
            up = tree.parent[i]
            for count in (chars, linked, tags, links):
                count[up] += count[i]
    share = linked[0] / max(chars[0], 1)
    own, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c = chars[i]
        if not c or tree.dropped[i]:
            continue
        t, lc, lt = max(tags[i], 1), max(linked[i], 1), max(links[i], 1)
        # the base is e or more, and its logarithm is held off zero for pages without links
        base = math.log(c / max(c - linked[i], 1) * lc + share * c + math.e)
        own[i] = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 0.05)
    for i in range(1, n):
        total[tree.parent[i]] += own[i]
    return own, total


def main_text(page: str) -> str:
    tree = Tree(page)
    own, total = densities(tree)
    n = len(own)
    best = max(range(n), key=lambda i: (total[i], own[i], -i))
    path = [best]
    while path[-1] > 0:
        path.append(tree.parent[path[-1]])
    threshold = min(own[i] for i in path)
    container = next((i for i in reversed(path) if tree.tag[i] in CONTAINERS), None)
    top = best if container is None else container
    # a node is text if it lies in the chosen subtree, or in another whose density reaches the threshold
    text = [False] * n
    on_path = set(path)
    for i in range(n):
        up = tree.parent[i]
        inherited = up >= 0 and text[up]
        other = i not in on_path and own[i] >= threshold > 0 and up in on_path
        text[i] = not tree.dropped[i] and (inherited or i == top or other)
    blocks: list[list[str]] = [[]]
    for node, piece in tree.pieces:
        if piece is None:
            if blocks[-1]:
                blocks.append([])
        elif text[node]:
            blocks[-1].append(piece)
    whole = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(b for b in whole if b)


def extract_text(df: DataFrame, passed: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The passed columns, the main text and its number of code points for every page."""
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in passed)

    def work(part, pages):
        texts = [main_text(p.decode("utf-8", "replace")) for p in pages]
        return {**{c: column_of(part, c) for c in passed}, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_text(df, html_col, f"{types}, text string, n_chars bigint", work, *passed)

"""Main text of web pages by tree scoring.

A page becomes a tree. Parts that are never article text (menus, page headers and footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are cut off by element, role, and the words of
class and id. Every paragraph then gets points for its length and commas, passes them to its parent in full
and to further ancestors in shrinking shares; a container's points are discounted by the share of its text
that is in links. The best container is kept with the siblings that score well beside it, and its blocks are
joined in page order.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^\"'>]*(?:\"[^\"]*\"[^\"'>]*|'[^']*'[^\"'>]*)*)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements of the language by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CUT_ELEMENTS = frozenset("nav footer aside form button select datalist dialog menu svg math canvas audio video object embed iframe input label fieldset".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: An open element is closed by the start of one of these, up to the nearest of the bounds.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
P_BOUNDS = frozenset("article aside body button caption div footer form header html li main nav section table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_WHOLE = frozenset("html body article main".split())

#: Words of class or id that mark a part as no article text; the second set also as the start of a word.
CUT_WORDS = frozenset("ad ads nav navigation menu menus aside foot masthead banner respond replies consent gdpr notice notices alert subscribe subscription signup popup modal overlay share sharing social related pager pagination toolbar login search header".split())
CUT_STARTS = ("advert", "adsense", "sponsor", "promo", "comment", "disqus", "cookie", "newsletter", "breadcrumb", "sidebar", "navbar", "footer")
#: Words that mark a part as article text, whatever its place is called otherwise.
CONTENT_WORDS = frozenset("article content main story entry post body text".split())
#: These are cut even where a content word stands beside them ("post-comments").
ALWAYS = ("comment", "disqus", "advert", "adsense", "sponsor", "cookie", "newsletter")

#: A sibling is kept from this share of the best container's points.
SIBLING = 0.2
#: Share of linked text from which a list or box of links is a menu.
MENU = 0.5


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "points", "size", "linked", "links")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.linked = self.links = 0


def _unwanted(tag: str, attrs: str, parents: list[Node]) -> bool:
    if tag in CUT_ELEMENTS:
        return True
    if tag == "header":
        # The header of an article keeps its headings (see _blocks); one of the page goes.
        return not any(n.tag in ("article", "main") for n in parents)
    if not attrs.strip():
        return False
    found = {m[0].lower(): m[1] or m[2] or m[3] or "" for m in (x.groups() for x in ATTRIBUTE.finditer(attrs))}
    if found.get("role", "").lower() in CUT_ROLES or found.get("aria-hidden", "").lower() == "true" and tag not in KEPT_WHOLE:
        return True
    if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        return tag not in ("html", "body")
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in PART.findall(names)}
    if any(w.startswith(ALWAYS) for w in words) and tag not in ("html", "body", "main"):
        return True
    if tag in KEPT_WHOLE or tag in INLINE or tag in HEADINGS or words & CONTENT_WORDS:
        return False
    return bool(words & CUT_WORDS) or any(w.startswith(CUT_STARTS) for w in words)


def tree(page: str) -> Node:
    """The element tree of a page; unclosed and misplaced tags are mended as browsers do."""
    root = Node("html", None)
    stack, open_count = [root], {"html": 1}
    at, size = 0, len(page)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_count[stack.pop().tag] -= 1

    def close(names: tuple[str, ...], bounds) -> None:
        if not any(open_count.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                return pop_to(depth)
            if stack[depth].tag in bounds:
                return None

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        tag = name.lower()
        if m["close"] or m["close2"]:
            if tag not in ("html", "body") and open_count.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                if depth:
                    pop_to(depth)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            close(("p",), P_BOUNDS - {"p"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        attrs = m["attrs"] or m["attrs2"] or ""
        node = Node(tag, stack[-1], stack[-1].cut or _unwanted(tag, attrs, stack))
        stack[-1].children.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            open_count[tag] = open_count.get(tag, 0) + 1
    return root


def _in_order(root: Node) -> list[Node]:
    """All nodes that are not cut, parents first."""
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if not node.cut:
            out.append(node)
            waiting += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def _block_text(node: Node) -> str:
    """Text of a node's own inline content."""
    parts, waiting = [], [node]
    while waiting:
        one = waiting.pop()
        if isinstance(one, str):
            parts.append(one)
        elif one is node or (one.tag in INLINE and not one.cut):
            parts.append(" " if one.tag in ("br", "wbr") else "")
            waiting += reversed(one.children)
    return " ".join("".join(parts).split())


def _score(nodes: list[Node]) -> None:
    """Text sizes, linked sizes and points of all nodes; children are summed before their parents."""
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.size += own
        if node.tag == "a":
            node.linked, node.links = node.size, 1
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.links += node.links
    for node in nodes:
        if node.tag in INLINE or node.tag in HEADINGS or node.size == 0:
            continue
        text = _block_text(node)
        if not text:
            continue
        points = len(text) / 100 + text.count(",") + (len(text) >= 25)
        above, level = node.parent if node.tag in ("p", "pre", "li", "td", "blockquote", "dd") else node, 0
        while above is not None and level < 6:
            above.points += points / (1, 2, 6, 9, 12, 15)[level]
            above, level = above.parent, level + 1


def _within(node: Node | None) -> bool:
    """Whether a node lies in an article or main element."""
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _menu(node: Node) -> bool:
    """A list or box of links outside the article; inside one only what is marked as a menu is (and is cut)."""
    return not _within(node) and node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.links >= 3 and _density(node) > MENU and node.linked < 60 * node.links


def _blocks(node: Node) -> list[str]:
    """The text blocks under a node in page order, without menus and without what an article header holds beside headings."""
    out: list[str] = []
    waiting: list[tuple[Node | str, bool]] = [(node, False)]
    inline: list[str] = []

    def flush() -> None:
        text = " ".join("".join(inline).split())
        inline.clear()
        if text:
            out.append(text)

    while waiting:
        one, head = waiting.pop()
        if one == "\n":
            flush()
        elif isinstance(one, str):
            if not head:
                inline.append(one)
        elif one.cut or (one is not node and _menu(one)):
            continue
        elif one.tag in INLINE:
            if one.tag == "br":
                inline.append(" ")
            waiting += [(c if not isinstance(c, str) or c != "\n" else " ", head) for c in reversed(one.children)]
        else:
            inner = (head or one.tag == "header") and one.tag not in HEADINGS
            flush()
            waiting.append(("\n", False))
            waiting += [(c if not isinstance(c, str) or c != "\n" else " ", inner) for c in reversed(one.children)]
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of one page as blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    nodes = _in_order(tree(page))
    _score(nodes)
    places = [n for n in nodes if n.tag not in INLINE and n.size and n.tag not in ("html", "head")]
    if not places:
        return "\n".join(_blocks(nodes[0]))
    best = max(places, key=lambda n: n.points * (1 - _density(n)))
    above = best
    while above is not None:
        # An article or main element around the best container is the author's own statement of its bounds.
        if above.tag in ("article", "main"):
            best = above
            if above.tag == "article":
                break
        above = above.parent
    if best.points <= 0:
        best = nodes[0]
    if best.parent is None or best.tag in ("html", "body"):
        return "\n".join(_blocks(best))
    first, last = _run(best)
    whole = Node("div", best.parent)
    whole.children = best.parent.children[first : last + 1]
    return "\n".join(_blocks(whole))


def _run(best: Node) -> tuple[int, int]:
    """Places of the first and the last sibling that belong to the best container; all between them do as well."""
    own = best.tag in ("article", "main")
    least = max(SIBLING * best.points * (1 - _density(best)), 1e-9)

    def kept(one: Node | str) -> bool:
        if isinstance(one, str) or one.cut or one.tag in INLINE or _density(one) >= 0.25 and one is not best:
            return one is best
        if one is best or one.tag == "article":
            return one is best or one.size > 0
        if one.tag in ("p", "pre", "blockquote"):
            return not own and len(_block_text(one)) >= 25
        return one.points * (1 - _density(one)) >= least and not _menu(one)

    siblings = best.parent.children
    places = [n for n, one in enumerate(siblings) if kept(one)]
    first, last = places[0], places[-1]
    element = lambda n: not isinstance(siblings[n], str) and not siblings[n].cut
    if not own:
        # Headings that lead to the run, and short parts that follow it in a container of its own.
        while any(element(n) and siblings[n].tag in ("h1", "h2") for n in range(first)):
            first = max(n for n in range(first) if element(n) and siblings[n].tag in ("h1", "h2"))
        ends = ("p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure")
        for n in range(last + 1, len(siblings)):
            if element(n) and siblings[n].tag in ends and _density(siblings[n]) < 0.25 and best.parent.tag not in ("html", "body"):
                last = n
            elif not isinstance(siblings[n], str):
                break
    return first, last


def extracted(page: Column) -> Column:
    """Main text of a column of HTML; a null or empty page, or one without text, gives an empty string.

    Equal pages give equal texts, very long ones are read whole, an empty table gives no rows; no other column
    is read.
    """

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return extract(page)

"""Main text of web pages by scoring the element tree.

Every paragraph passes points, for itself, its commas and its length, to its parent in full and to farther
ancestors in falling shares; a container's points are discounted by the share of its text inside
links. The best container wins; its siblings are kept if they score well too, or read like paragraphs or headings of
it. What names itself as navigation, advert, form, notice, comment and the like takes no part, unless the page
holds more text under such names than was kept and the best container, names counted as a penalty on its points
and on the length of its text, lies below one: then the words that name it say nothing on this page.

A small reader builds the tree from one pass over the source: it closes what HTML closes by itself, passes over the
content of scripts and styles, and does not mind what is left open or closed twice.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes, and the elements the search for it does not leave.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")), "body": (("head",), ("html",)), "a": (("a",), ("td", "th", "table", "li", "div")),
}
SCOPE = frozenset("html body table td th caption button object template".split())

DROPPED = frozenset("head script style noscript template nav aside footer form button select option textarea input label fieldset iframe frameset object embed "
                    "svg canvas dialog menu audio video map search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
NAMES = frozenset(
    "ad ads advert advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside rail footer masthead header topbar toolbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond replies discussion "
    "pagination pager widget skip search copyright".split()
)
#: Before a name, in one class: it tells of the layout around, not of the box.
LAYOUT = frozenset("with has no without hide show".split())
#: Beside a name, signs that the box holds the text after all. Not so for the words of APART.
HOLDS = frozenset("content article body entry post story text main page layout wrapper wrap container theme single".split())
APART = frozenset("ad ads advert advertisement advertising adsense adslot adbox sponsor sponsored comment comments commentlist disqus respond replies "
                  "discussion cookie cookies consent gdpr".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*+)", re.S)
_ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
#: Searches for the end of a tag that meet an open quote may read so many lengths of the page; then so many characters each.
OPEN_PAGES, OPEN_CHARS = 64, 4096
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden|type)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z|\")?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LETTER = re.compile(r"[^\W_]")
#: Links of menus have up to so many characters.
ITEM = 50
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "parent", "children", "attrs", "dropped", "length", "linked", "score", "own_text", "in_p", "weight", "plain", "longest")

    def __init__(self, tag: str, parent: Node | None, attrs: str):
        self.tag, self.parent, self.attrs, self.children = tag, parent, attrs, []
        self.dropped, self.length, self.linked, self.score, self.own_text, self.weight = False, 0, 0, 0.0, 0, 1.0
        self.plain, self.longest = False, 0
        self.in_p = tag == "p" or parent is not None and parent.in_p and tag not in SCOPE


def tree(source: str) -> list[Node]:
    """All elements, parents first; text children are raw strings."""
    root = Node("html", None, "")
    nodes, now, at, n = [root], root, 0, len(source)
    spent = 0  # characters read in vain for tags with an open quote

    def close(names: tuple[str, ...], stops) -> None:
        nonlocal now
        x = now
        while x is not root:
            if x.tag in names:
                now = x.parent
                return
            if x.tag in stops:
                return
            x = x.parent

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            now.children.append(source[at:])
            break
        if m.start() > at:
            now.children.append(source[at: m.start()])
        at = m.end()
        tag, end = m["tag"], m["end"]
        if tag:
            stop = _ATTRS.match(source, at, n if spent <= OPEN_PAGES * n else min(n, at + OPEN_CHARS)).end()
            if source[stop: stop + 1] != ">":  # a quote stays open: the tag ends at the first bracket
                spent += stop - at
                stop = source.find(">", at)
                stop = n if stop < 0 else stop
            tag, attrs, at = tag.lower(), source[at:stop], min(stop + 1, n)
            if tag == "html" or tag == "body" and any(x.tag == "body" for x in _path(now)):
                continue
            if now.in_p and tag in CLOSES_P:
                close(("p",), SCOPE)
            if tag in SIBLINGS:
                close(*SIBLINGS[tag])
            if tag in HEADINGS and now.tag in HEADINGS:
                now = now.parent
            node = Node(tag, now, attrs)
            now.children.append(node)
            nodes.append(node)
            if tag in RAW:
                stop = _RAW_END[tag].search(source, at)
                at = stop.end() if stop else n
            elif tag not in VOID and not attrs.endswith("/") or tag in BLOCK and tag not in VOID:
                now = node
        elif end:
            end = end.lower()
            if end not in ("html", "body"):
                block, x = end in BLOCK, now
                while x is not root:
                    if x.tag == end or block and end in HEADINGS and x.tag in HEADINGS:
                        now = x.parent
                        break
                    if not block and x.tag in BLOCK or block and x.tag in ("td", "th", "table", "body") and end not in ("tr", "table", "tbody", "thead", "tfoot", "td", "th"):
                        break
                    x = x.parent
        elif m["cdata"]:
            now.children.append(html.escape(m["cdata"], quote=False))
    return nodes


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _words(node: Node) -> Iterator[str]:
    """The words of an element's classes and id, without those that tell of the layout around it."""
    if node.tag in HEADINGS or node.tag in ("html", "body", "main", "header"):
        return
    for name, a, b, c in _ATTR.findall(node.attrs):
        if name.lower() in ("class", "id"):
            for token in (a or b or c).split():
                before = ""
                for w in _NAME.findall(token):
                    w = w.lower()
                    if before not in LAYOUT:
                        yield w
                    before = w


def _aside(node: Node, names: frozenset[str] = NAMES) -> bool:
    """Whether an element is by its kind or names no part of an article."""
    tag = node.tag
    if tag in DROPPED:
        return True
    if tag == "header":  # an article's own header holds its title
        return not any(x.tag in ("article", "main") for x in _path(node.parent))
    if not node.attrs or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in _ATTR.findall(node.attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return bool(names) and any(w in names for w in _words(node))


def _weight(node: Node) -> float:
    """What an element's text counts for, by its own names."""
    words = set(_words(node)) if node.attrs else set()
    if not words & NAMES:
        return 1.0
    return 0.02 if words & APART else 0.5 if words & HOLDS else 0.2


def _measure(nodes: list[Node], names: frozenset[str] = NAMES) -> None:
    for node in nodes:
        parent = node.parent
        node.dropped = parent is not None and (parent.dropped or _aside(node, names))
        node.length, node.linked, node.score, node.own_text, node.plain, node.longest = 0, 0, 0.0, 0, False, 0
    # a wrapper named after its sidebar still holds the article
    for node in nodes:
        if node.tag in ("h1", "main") and node.dropped:
            path = [x for x in _path(node) if x.dropped]
            if all(x.tag in ("div", "section", "h1", "main", "article", "header", "span", "a") for x in path) and not any(
                    x.tag in ("article", "main") and not x.dropped for x in nodes) and not any(_hidden_or_role(x) for x in path):
                top = path[-1]
                top.dropped = False
                for x in nodes:
                    if any(y is top for y in _path(x.parent)):
                        x.dropped = x.parent.dropped or _aside(x, names)
                break
    for node in reversed(nodes):
        if node.dropped:
            continue
        own = sum(len(c.strip()) for c in node.children if c.__class__ is str)
        node.own_text = own
        node.length += own
        node.plain = node.plain or own > 0 and any(c.__class__ is str and _LETTER.search(html.unescape(c) if "&" in c else c) for c in node.children)
        if node.tag == "a":
            node.linked = node.longest = node.length
            node.plain = False
        if node.parent is not None:
            node.parent.plain = node.parent.plain or node.plain
            node.parent.longest = max(node.parent.longest, node.longest)
            node.parent.length += node.length
            node.parent.linked += node.linked


def _misleading(nodes: list[Node]) -> tuple[set[str], float]:
    """The names above the best container when names are a penalty only, and its weight."""
    _measure(nodes, frozenset())
    for node in nodes:
        node.weight = min(node.parent.weight if node.parent is not None else 1.0, _weight(node))
    _score(nodes)
    best = max(nodes, key=lambda x: 0.0 if x.dropped else x.score * (1 - _density(x)))
    weight = best.weight
    for node in nodes:
        node.weight = 1.0
    if best.dropped or best.score <= 0:
        return set(), 0.0
    return {w for x in _path(best) for w in _words(x) if w in NAMES}, weight


def _hidden_or_role(node: Node) -> bool:
    return any(name.lower() in ("hidden", "aria-hidden", "role") for name, *_ in _ATTR.findall(node.attrs or ""))


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _menu(node: Node) -> bool:
    """Whether a box holds short links and nothing but marks between them."""
    return node.length > 0 and _density(node) > 0.5 and not node.plain and node.longest <= ITEM


def _commas(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if c.__class__ is str:
                total += c.count(",") + c.count("，") + c.count("、") + c.count("،")
            elif not c.dropped:
                stack.append(c)
    return total


PARAGRAPHS = frozenset("p pre blockquote td li dd figcaption".split())


def _is_paragraph(node: Node) -> bool:
    if node.tag in PARAGRAPHS:
        return True
    return node.tag in ("div", "section", "article", "main", "body", "html") and node.own_text >= 25


def _score(nodes: list[Node]) -> None:
    for node in nodes:
        if node.dropped or not _is_paragraph(node):
            continue
        size = node.length if node.tag in PARAGRAPHS else node.own_text
        if size < 25:
            continue
        points = (1 + _commas(node) + min(size / 100, 3)) * (1 - _density(node)) * node.weight
        x, level = node.parent if node.tag in PARAGRAPHS else node, 0
        while x is not None and level < 6:
            x.score += points * (1.0 if level == 0 else 0.5 if level == 1 else 1 / (3 * level))
            x, level = x.parent, level + 1


def _kept(nodes: list[Node]) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    found = [(x.score * (1 - _density(x)), x) for x in nodes if x.score > 0 and not x.dropped]
    if not found:
        return [nodes[0]] if nodes[0].length else []
    best_score, best = max(found, key=lambda f: f[0])  # the first of equals
    for x in _path(best):
        if x.tag == "article":
            best = x
            break
    else:
        while best.parent is not None and best.parent.tag not in ("body", "html") and best.parent.score * (1 - _density(best.parent)) >= 0.5 * best_score:
            best = best.parent
    if best.parent is None:
        return [best]
    limit, out = max(10.0, 0.2 * best_score), []
    for c in best.parent.children:
        if c is best:
            out.append(c)
        elif c.__class__ is not str and not c.dropped and c.length:
            density = _density(c)
            if c.score * (1 - density) >= limit and density < 0.25 or c.tag == "p" and (c.length > 80 and density < 0.25 or density == 0 and best.tag == "p"):
                out.append(c)
            elif c.tag in HEADINGS and density == 0 and best.tag != "article":
                out.append(c)
    return out


def _blocks(top: Node, out: list[str]) -> None:
    """Blocks of text below `top`, without recursion; boxes of short links are menus, but not inside an article."""
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif x.__class__ is str:
            line.append(html.unescape(x) if "&" in x else x)
        elif x.dropped or x is not top and top.tag != "article" and x.tag in ("ul", "ol", "div", "section", "table", "dl") and _menu(x):
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            line.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()


def main_text(source: str | None) -> str:
    """The blocks of the main text, one per line; empty if there is none."""
    if not source:
        return ""
    nodes = tree(source)
    text = _text(nodes, NAMES)
    if sum(len(c.strip()) for x in nodes if x.dropped for c in x.children if c.__class__ is str) > len(text):
        spared, weight = _misleading(nodes)
        if spared:
            other = _text(nodes, NAMES - spared)
            if weight * len(other) > len(text):
                return other
    return text


def _text(nodes: list[Node], names: frozenset[str]) -> str:
    _measure(nodes, names)
    _score(nodes)
    out: list[str] = []
    for top in _kept(nodes):
        _blocks(top, out)
    return "\n".join(out)


def extracted(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return run(page)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """`pages` with text and n_chars (code points) in place of the source.

    Null and empty sources, and pages without text, give an empty text. Rows are read one by one, so repeated rows
    give equal texts; columns named text or n_chars are replaced. Nothing is cut, however long.
    """
    out = pages.withColumn("text", extracted(F.col(page)))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).drop(*([page] if page not in ("text", "n_chars") else []))

"""Small page trees: a forgiving parser, what is boilerplate by its name, and blocks of text."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# What opening one of the first closes, if open inside the nearest of the last.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_HOLDS_P = frozenset({"td", "th", "table", "button"})

# Parts of a page that are never its article.
OTHER_TAGS = frozenset(
    "nav header footer aside form script style noscript template iframe button select textarea svg dialog menu head object "
    "canvas audio video title".split()
)
# Words in class names and ids that say so of any element.
OTHER_NAMES = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead topbar footer foot sidebar aside cookie cookies consent gdpr notice alert popup "
    "modal overlay share sharing social comment comments reply replies respond discussion disqus related recommended "
    "recommendations newsletter subscribe subscription signup login search pagination pager copyright toolbar skip".split()
)
# Words that say so only as the first of a name.
OTHER_FIRST = frozenset({"widget"})
# Words of names that tell what else there is.
ABOUT_OTHERS = frozenset("has have with without no not".split())
# First words of the names of an article's own header, and names and least size of a lead in it.
OWN = frozenset("article entry post story content single".split())
LEAD = frozenset("lead lede intro summary abstract standfirst subtitle dek".split())
LEAD_CHARS = 40
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# Elements nested deeper than this become neighbours of the last, as in browsers.
MAX_DEPTH = 400

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_attr = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_name_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
_digits = re.compile(r"\d+")


class Node:
    """An element: its tag, a label that pages of one kind share, children (elements and texts)."""

    __slots__ = ("attrs", "children", "label", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []
        named = ".".join(sorted(attrs.get("class", "").split()))
        self.label = tag + (f".{named}" if named else "") + (f"#{attrs['id']}" if attrs.get("id") else "")
        if "#" in self.label or named:
            # Paths are labels with slashes between.
            self.label = _digits.sub("0", self.label).replace("/", "_")

    def elements(self) -> list[Node]:
        """Children that are elements."""
        return [c for c in self.children if isinstance(c, Node)]


def parse(page: str) -> Node:
    """The tree of a page, whatever its markup is like. Elements left open end with their parent."""
    root = Node("#root", {})
    stack, opened = [root], Counter()
    at = 0

    def pop_to(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    def close_open(tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in bounds:
                return
            if stack[depth].tag in tags:
                pop_to(depth)
                return

    while True:
        found = _token.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            stack[-1].children.append(html.unescape(text))
        if not found:
            return root
        at = found.end()
        if not found["tag"]:
            continue
        tag = found["tag"].lower()
        if found["close"]:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag and (tag in BLOCK or stack[depth].tag not in BLOCK):
                    depth -= 1
                if stack[depth].tag == tag:
                    pop_to(depth)
            continue
        attrs = {}
        for name, a, b, c in _attr.findall(found["attrs"]):
            attrs.setdefault(name.lower(), html.unescape(a or b or c))
        if tag in BLOCK:
            close_open({"p"}, _HOLDS_P)
        if tag in CLOSES:
            close_open(*CLOSES[tag])
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)
            opened[tag] += 1


def name_words(node: Node) -> list[str]:
    """Words in the class names and the id of an element."""
    return _name_words(node.attrs.get("class", "") + " " + node.attrs.get("id", "")) if node.attrs else []


def named_other(node: Node) -> bool:
    """Whether a class name or the id says that an element is no part of an article.

    A name that says what an element has or lacks (``has-sidebar``, ``no-sidebar``,
    ``page-with-menu``) says nothing of the element itself; names such as ``hidden-xs`` and
    ``elementor-widget`` are those of layouts.
    """
    for name in (node.attrs.get("class", "") + " " + node.attrs.get("id", "")).split():
        words = [w.lower() for w in _name_words(name)]
        if not words or not ABOUT_OTHERS.isdisjoint(words):
            continue
        if any(w in OTHER_NAMES for w in words) or words[0] in OTHER_FIRST or words == ["hidden"]:
            return True
    return False


def is_own_header(node: Node) -> bool:
    """Whether an element in an article is its header, by tag or a name like ``entry-header``."""
    if node.tag == "header":
        return True
    names = [[w.lower() for w in _name_words(n)] for n in node.attrs.get("class", "").split()]
    return any(len(n) > 1 and n[-1] == "header" and n[0] in OWN for n in names)


def is_other(node: Node, in_article: bool) -> bool:
    """Whether an element is no part of an article by its tag, role, names or being hidden."""
    own_header = in_article and is_own_header(node)
    if node.tag in OTHER_TAGS and not own_header:
        return True
    attrs = node.attrs
    if not attrs or node.tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in OTHER_ROLES:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if node.tag == "article":
        return any(n.lower() in ("comment", "reply", "ad", "sponsored", "related") for n in name_words(node))
    return node.tag != "main" and not own_header and named_other(node)


def landmarks(root: Node) -> set[int]:
    """Ids of the elements that hold the page's main element with the most text, or without one
    its largest article: what the page names its article is never cut with something around it."""
    best: dict[str, tuple[int, list[int]]] = {}

    def visit(node: Node, above: list[int]) -> int:
        size = 0
        inside = [*above, id(node)]
        for child in node.children:
            size += len("".join(child.split())) if isinstance(child, str) else visit(child, inside)
        if node.tag in RAW or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
            return 0
        if node.tag in ("article", "main") and size and not is_other(node, False) and size > best.get(node.tag, (0, []))[0]:
            best[node.tag] = size, above
        return size

    visit(root, [])
    found = best.get("main") or best.get("article")
    return set(found[1]) if found else set()


def pruned(node: Node, in_article: bool = False) -> Node:
    """The tree without what is boilerplate by its name. Elements around the page's own article
    stay; an article's own header keeps its headings and what is named or reads like a lead."""
    return _pruned(node, in_article, landmarks(node))


def _pruned(node: Node, in_article: bool, around: set[int]) -> Node:
    inside = in_article or node.tag in ("article", "main")
    header = in_article and is_own_header(node)
    kept: list[Node | str] = []
    for child in node.children:
        if isinstance(child, str):
            if not header:
                kept.append(child)
        elif id(child) in around or not is_other(child, inside) and not (header and not _is_title(child)):
            kept.append(_pruned(child, inside, around))
    node.children = kept
    return node


def _is_title(node: Node) -> bool:
    """Whether a part of an article's header is its text: a heading, a lead, or a long paragraph."""
    words = {w.lower() for w in name_words(node)}
    lead = not words.isdisjoint(LEAD) or (node.tag == "p" and not words and text_size(node) > LEAD_CHARS)
    return lead or _has_heading(node)


def _has_heading(node: Node) -> bool:
    return node.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup") or any(_has_heading(c) for c in node.elements())


def walk(node: Node, path: str = "") -> Iterator[tuple[str, Node]]:
    """Every element with its path of labels, in page order."""
    own = f"{path}/{node.label}"
    yield own, node
    for child in node.elements():
        yield from walk(child, own)


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a tree in page order, white space made one space, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    def visit(n: Node) -> None:
        block = n.tag in BLOCK
        if block:
            flush()
        for child in n.children:
            if isinstance(child, str):
                run.append(child)
            elif child.tag == "br":
                run.append(" ")
            else:
                visit(child)
        if block:
            flush()

    visit(node)
    flush()
    return out


def text_size(node: Node) -> int:
    """Characters of text in a tree, white space apart."""
    return sum(len("".join(c.split())) if isinstance(c, str) else text_size(c) for c in node.children)

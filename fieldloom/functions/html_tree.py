"""Small per-page helper: an element tree, a CSS subset and plain text.

Spark spreads the pages; this only reads one page at a time inside an Arrow UDF.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

# Element classes of HTML.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre"
    " section summary table tbody td tfoot th thead tr ul".split()
)
SILENT_TAGS = frozenset("head script style title".split())
INLINE_IN_PARAGRAPH = frozenset(["br", "body", "html"])

# An opening tag on the left ends an open element of the same group.
SELF_CLOSING_GROUPS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr",),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}

_SELECTOR = re.compile(
    r'^(?P<tag>\w+)?(?:\.(?P<token>[\w-]+))?(?:\[(?P<attr>\w+)(?P<part>\*)?="(?P<value>[^"]*)"\])?$'
)


class Comment(str):
    """A comment: it counts as a child but has no text."""


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = attrs
        self.parent = parent
        self.children = []


class _TreeBuilder(HTMLParser):
    def __init__(self, dropped):
        super().__init__(convert_charrefs=True)
        self.dropped = dropped
        self.root = self.open = Element("", {}, None)
        self.counts = Counter()  # open elements by tag

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS and tag not in INLINE_IN_PARAGRAPH:
            self._close(("p",), within=None)
        if tag in SELF_CLOSING_GROUPS:
            self._close(SELF_CLOSING_GROUPS[tag], within=("ul", "ol", "dl", "table", "select"))
        element = Element(tag, {k: v or "" for k, v in attrs}, self.open)
        if tag not in self.dropped:
            self.open.children.append(element)
        if tag not in VOID_TAGS:
            self.open = element
            self.counts[tag] += 1

    def handle_endtag(self, tag):
        self._close((tag,), within=None)

    def handle_data(self, data):
        self.open.children.append(data)

    def handle_comment(self, data):
        self.open.children.append(Comment(data))

    def _close(self, tags, within):
        if not any(self.counts[tag] for tag in tags):  # no walk for an end tag that ends nothing
            return
        element = self.open
        while element.parent is not None:
            if element.tag in tags:
                self._leave(element)
                return
            if within and element.tag in within:
                return
            element = element.parent

    def _leave(self, element):
        while self.open is not element.parent:
            self.counts[self.open.tag] -= 1
            self.open = self.open.parent


def parse(html: str, dropped=()) -> Element:
    """Element tree of a page without the dropped subtrees."""
    builder = _TreeBuilder(frozenset(dropped))
    builder.feed(html)
    builder.close()
    return builder.root


def elements(root: Element) -> list[Element]:
    """Elements below ``root`` in document order."""
    found, stack = [], [root]
    while stack:
        element = stack.pop()
        found.append(element)
        stack.extend(c for c in reversed(element.children) if isinstance(c, Element))
    return found[1:]


def plain_text(element: Element) -> str:
    """Text with one line per block and single spaces inside a line."""
    pieces, stack = [], [element]
    while stack:
        item = stack.pop()
        if isinstance(item, Comment):
            continue
        if isinstance(item, str):
            pieces.append(item.replace("\n", " "))
        elif item.tag not in SILENT_TAGS:
            edge = "\n" if item.tag in BLOCK_TAGS else ""
            pieces.append(edge)
            stack.append(edge)
            stack.extend(reversed(item.children))
    lines = (" ".join(line.split()) for line in "".join(pieces).split("\n"))
    return "\n".join(line for line in lines if line)


def only_string(element: Element) -> str | None:
    """The string an element consists of, directly or through single children."""
    while len(element.children) == 1:
        child = element.children[0]
        if isinstance(child, str):
            return child
        element = child
    return None


def compact_length(element: Element) -> int:
    """Length of all strings below an element, each stripped."""
    strings = [c for e in [element, *elements(element)] for c in e.children if isinstance(c, str)]
    return sum(len(s.strip()) for s in strings if not isinstance(s, Comment))


def compile_selector(selector: str):
    """Test for one selector: tag, .class, [attr="v"] or [attr*="v"], also combined."""
    parts = _SELECTOR.match(selector)
    if parts is None:
        raise ValueError(f"unsupported selector: {selector}")
    tag, token, attr, part, value = parts.group("tag", "token", "attr", "part", "value")

    def test(element: Element) -> bool:
        if tag and element.tag != tag:
            return False
        if token and token not in element.attrs.get("class", "").split():
            return False
        if attr:
            held = element.attrs.get(attr)
            return held is not None and (value in held if part else value == held)
        return True

    return test


def first_matches(found: list[Element], tests) -> list[Element | None]:
    """First element each test accepts, in the order of the tests."""
    return [next((e for e in found if test(e)), None) for test in tests]


def page_body(root: Element, found: list[Element]) -> Element:
    """The body, or everything when the page has none."""
    return next((e for e in found if e.tag == "body"), root)

"""A small tolerant HTML tree on the standard library's tokenizer: void elements, implied ends of p, li, td and the like."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag ends, if it is the innermost of its kind within the given borders.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_][^\W_'’-]*(?:['’-]+[^\W_'’-]*)*")


def squeezed(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def count_words(text: str) -> int:
    """Runs that begin with a letter or digit and go on with these, apostrophes and hyphens."""
    return sum(1 for _ in _WORD.finditer(text))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "data")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None, data: str = ""):
        self.tag, self.attrs, self.parent, self.data = tag, attrs or {}, parent, data
        self.children: list[Node] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in order of the document."""
        todo = self.children[::-1]
        while todo:
            n = todo.pop()
            if n.tag != "#text":
                yield n
                todo.extend(n.children[::-1])

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if n.tag == "#text":
                out.append(n.data)
            else:
                todo.extend(n.children[::-1])
        return "".join(out)

    def above(self) -> Iterator[Node]:
        n = self
        while n is not None:
            yield n
            n = n.parent

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.at = self.root

    def _close(self, tags: set[str], borders: set[str]) -> None:
        for n in self.at.above():
            if n.tag in tags:
                self.at = n.parent
                return
            if n.tag in borders or n.parent is None:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag == "body" and self.at.tag == "head":
            self.at = self.at.parent
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        node = Node(tag, first, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        for n in self.at.above():
            if n.tag == tag:
                self.at = n.parent
                return

    def handle_data(self, data):
        self.at.children.append(Node("#text", parent=self.at, data=data))


def parse(html: str) -> Node:
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
    except (AssertionError, ValueError):  # a declaration that the tokenizer can't read: keep what there is
        pass
    return builder.root

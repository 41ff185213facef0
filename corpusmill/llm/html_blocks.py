"""Leaf text blocks of HTML pages: a tolerant tokenizer and an open-element stack.

Paths are a tree of elements that link to their parents, one node for all elements with the same names on the same path, so what a
page holds, and the time it takes, grow with its length however deep it is nested.
"""

from __future__ import annotations

import collections
import functools
import html
import re
from collections.abc import Iterator

#: Elements that end a block, that never have content, and whose content isn't text of the page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template iframe textarea svg".split())
#: Of these, those that hold elements: without an end tag they hold nothing, while the others go on to the end of the page.
LOOSE = frozenset("svg".split())
#: What stands for scripts, plug-ins and media where they don't run: blocks like others.
BLOCKS |= frozenset("noscript object audio video canvas".split())
#: What an opening tag closes if it is open inside the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: An open paragraph is closed by these, and never holds them.
ENDS_P = BLOCKS - {"html", "body", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _names(attributes: str) -> str:
    """The words of the attributes that tell what an element is for, in lower case."""
    if "=" not in attributes:
        return ""
    return " ".join((a or b or c) for _, a, b, c in _ATTRIBUTE.findall(attributes)).lower()


#: Elements that are part of a running text, not containers of their own.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tbody thead tfoot tr td th caption blockquote pre figure figcaption address".split())


class Node:
    """An element on its path: ``new`` are the features (of what it and its names are called) that no element above it has.

    ``holder`` is the nearest element from here on up that is no part of a running text.
    """

    __slots__ = ("tag", "names", "parent", "children", "new", "holder", "main")

    def __init__(self, tag: str, names: str, parent: Node | None, new: tuple[str, ...]):
        self.tag, self.names, self.parent, self.new = tag, names, parent, new
        self.children: dict[tuple[str, str], Node] = {}
        self.holder = parent.holder if parent and tag in PARTS else self
        self.main = bool(parent and parent.main) or tag in ("article", "main")

    def features(self) -> list[str]:
        """What the elements from the root to this one tell."""
        up = self.parent.tag if self.parent else ""
        out = {f"own:{self.tag}", f"up:{up}"}
        node: Node | None = self
        while node is not None:
            out.update(node.new)
            node = node.parent
        if not self.main:
            out.add("not in article or main")
        return sorted(out)


@functools.lru_cache(maxsize=50_000)
def _told(tag: str, names: str) -> tuple[str, ...]:
    return (f"in:{tag}", *(f"name:{w}" for w in dict.fromkeys(re.split(r"[^a-z]+", names)) if w))


class _Open:
    """The open block elements, with where each name stands among them and how often each feature is told."""

    def __init__(self) -> None:
        self.nodes = [Node("", "", None, ())]
        self.at: dict[str, list[int]] = {}
        self.told: collections.Counter[str] = collections.Counter()

    def push(self, tag: str, names: str) -> None:
        above = self.nodes[-1]
        node = above.children.get((tag, names))
        if node is None:
            node = above.children[tag, names] = Node(tag, names, above, tuple(f for f in _told(tag, names) if not self.told[f]))
        self.told.update(_told(tag, names))
        self.at.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        """Where the innermost element of ``tags`` stands; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, at: int) -> None:
        """Closes the element at ``at`` and all inside it; nothing if it is 0."""
        while at and len(self.nodes) > at:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            self.told.subtract(_told(node.tag, node.names))


def on_nodes(page: list[tuple]) -> list[tuple[Node, str, int]]:
    """Blocks whose elements may be given as paths, ((tag, names), ...) from the root, as blocks on one tree of elements."""
    if all(isinstance(where, Node) for where, _, _ in page):
        return page
    opened, out = _Open(), []
    for path, text, linked in page:
        opened.close(1)
        for tag, names in path:
            opened.push(tag, names)
        out.append((opened.nodes[-1], text, linked))
    return out


def blocks(page: str | None) -> Iterator[tuple[Node, str, int]]:
    """(element, text, characters inside links) of each leaf block with text, in page order.

    Character references are decoded; white space is one space; the block is trimmed.  Unclosed and stray tags are taken as
    browsers do.
    """
    page = page or ""
    opened = _Open()
    held: list[str] = []
    links: list[str] = []
    in_link = 0
    at = 0
    skip = None
    endless: set[str] = set()  # elements of which no end tag follows

    def text(part: str) -> None:
        if part:
            held.append(part)
            if in_link:
                links.append(part)

    def flush() -> Iterator[tuple[Node, str, int]]:
        if held:
            joined = "".join(held)
            made = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if made:
                yield opened.nodes[-1], made, sum(map(len, links))
            held.clear()
            links.clear()

    for m in _TOKEN.finditer(page):
        if skip is not None:
            if m.start() < at:
                continue
            skip = None
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing = name.lower(), m[1] or m[4]
        if name in UNSEEN:
            if not closing and not (m[3] or m[6] or "").rstrip().endswith("/"):
                pattern = r"</head\b[^>]*>|(?=<body\b)" if name == "head" else rf"</{name}\b[^>]*(?:>|\Z)"  # a body may follow a head without an end tag
                end = None if name in endless else re.compile(pattern, re.I).search(page, at)
                if end is None:
                    endless.add(name)
                at = end.end() if end else (at if name == "head" or name in LOOSE else len(page))
                skip = name
            held.append(" ")
            continue
        if name == "a":
            in_link = max(0, in_link - 1) if closing else in_link + 1
            continue
        if name == "br" or name in VOID and name != "hr":
            held.append(" ")
            continue
        if name in BLOCKS:
            yield from flush()
            in_link = 0
        elif name not in ("form", "label", "button"):
            continue
        if closing:
            opened.close(opened.last((name,)))
            continue
        if name == "hr":
            continue
        if name in ENDS_P:
            opened.close(opened.last(("p",)))
        if name in CLOSES:
            closed, bounds = CLOSES[name]
            while (inner := opened.last(closed)) > opened.last(bounds):
                opened.close(inner)
        if name in BLOCKS:
            opened.push(name, _names(m[3] or m[6] or ""))
    text(page[at:] if skip is None or at < len(page) else "")
    yield from flush()

"""HTML read as a sequence of leaf blocks: runs of text between block tags, with the elements that stand around them.

Reading is a state machine that moves on through the page and never goes back, and each open element is one node that knows its parent, so time
and memory follow the length of the page, whatever is left open or unclosed in it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from typing import NamedTuple

#: Elements that end a run of text where they start and end.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page and holds no tags. If one is never closed it takes the rest of the page, as in a browser.
RAW = frozenset("script style textarea".split())
#: Elements that divide a page; the innermost around a block says most about it.
SECTIONS = frozenset("article aside body dialog div fieldset footer form head header main menu nav section td".split())
#: Elements that an element's start tag ends, if they are open within the nearest of the second set.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
#: Block elements that don't end an open paragraph.
INSIDE_P = frozenset({"button", "label", "option", "select", "body", "html", "head", "title"})
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: One attribute, or the end of a tag; what follows ``=`` may be quoted, in which case the quote that closes it may be missing at the page's end.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)("?)|'([^']*+)('?)|([^\s>"'][^\s>]*+)?+))?+)""")
ENDING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
WORDS = re.compile(r"[a-z]+")


class Node(NamedTuple):
    """An open element: its name, the words of its class, id and role, its parent, its depth from 1 and the nearest section that it is or lies in."""

    name: str
    named: tuple[str, ...]
    parent: Node | None
    depth: int
    near: Node | None

    def path(self) -> list[Node]:
        """The elements from the outermost to this one."""
        out, node = [], self
        while node is not None:
            out.append(node)
            node = node.parent
        return out[::-1]


class Block(NamedTuple):
    text: str
    node: Node | None  # the innermost element around the text
    linked: int  # characters of the text within links


class _Open:
    """The open elements, with the places of those of each name and of all blocks."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def push(self, name: str, named: tuple[str, ...]) -> None:
        parent = self.nodes[-1] if self.nodes else None
        at = len(self.nodes)
        node = Node(name, named, parent, at + 1, parent.near if parent else None)
        self.nodes.append(node._replace(near=node) if name in SECTIONS else node)
        self.places[name].append(at)
        if name in BLOCKS:
            self.blocks.append(at)

    def close(self, to: int) -> None:
        """End the element at a place and all within it."""
        while len(self.nodes) > to:
            name = self.nodes.pop().name
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()


def blocks(html: str | None) -> list[Block]:
    """Blocks with text in page order; character references decoded, white space within a block turned into one space.

    Tags are read as browsers read them: a quote counts only where a value starts, and a tag or comment that the page's end cuts off is no text.
    """
    out: list[Block] = []
    open_ = _Open()
    pieces: list[str] = []
    linked = at = 0
    html = html or ""

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            linked += len(text.strip()) if open_.places["a"] else 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            if text := " ".join("".join(pieces).split()):
                out.append(Block(text, open_.nodes[-1] if open_.nodes else None, min(linked, len(text))))
            pieces.clear()
        linked = 0

    while (start := html.find("<", at)) >= 0:
        follows = html[start + 1 : start + 2]
        if follows.isascii() and follows.isalpha():
            take(html[at:start])
            name, named, closed, at = _tag(html, start + 1)
            if name is None:
                break
            if name in RAW:
                if not closed:
                    ending = ENDING[name].search(html, at)
                    at = _tag(html, ending.start() + 2)[3] if ending else len(html)
                continue
            if name in BLOCKS:
                flush()
                _start(open_, name)
            elif name in ("br", "img", "input"):
                pieces.append(" ")
            if name not in VOID and not closed:
                open_.push(name, named)
        elif follows == "/" and html[start + 2 : start + 3].isascii() and html[start + 2 : start + 3].isalpha():
            take(html[at:start])
            name, _, _, at = _tag(html, start + 2)
            if name is None:
                break
            if name in BLOCKS:
                flush()
            depth = open_.last((name,))
            # An inline end tag doesn't end the blocks within its element.
            if depth >= 0 and (name in BLOCKS or not open_.blocks or open_.blocks[-1] < depth):
                open_.close(depth)
        elif follows in ("!", "?", "/") and follows:
            take(html[at:start])
            at = _beyond(html, "-->", start + 2) if html.startswith("<!--", start) else _beyond(html, ">", start + 2)
        else:  # a sign of its own
            take(html[at : start + 1])
            at = start + 1
    else:
        take(html[at:])
    flush()
    return out


def _beyond(html: str, mark: str, at: int) -> int:
    found = html.find(mark, at)
    return found + len(mark) if found >= 0 else len(html)


def _tag(html: str, at: int) -> tuple[str | None, tuple[str, ...], bool, int]:
    """From where a tag's name starts: the name, the words of class, id and role, whether it closes itself, and where it ends; no name if the page ends first."""
    name = NAME.match(html, at)
    at = name.end()
    named: list[str] = []
    while found := ATTRIBUTE.match(html, at):
        if found[1]:
            return name[0].lower(), tuple(named), html[found.end() - 2] == "/" and found.end() - 2 >= at, found.end()
        at = found.end()
        if found[3] is not None and not found[4] or found[5] is not None and not found[6]:
            break
        if found[2].lower() in ("class", "id", "role"):
            named += WORDS.findall((found[3] or found[5] or found[7] or "").lower())
    return None, (), False, len(html)


def _start(open_: _Open, name: str) -> None:
    """End what a block's start tag ends."""
    ends, within = ENDS.get(name, ((), ()))
    if name not in INSIDE_P:
        ends = (*ends, "p")
    while True:
        last = open_.last(ends)
        barrier = open_.last(within) if name in ENDS else open_.blocks[-1] if open_.blocks else -1
        if last < 0 or last < barrier:
            return
        open_.close(last)

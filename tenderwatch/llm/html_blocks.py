"""Leaf blocks of an HTML page: text between block boundaries, and what it stands in."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass

# Element kinds of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no text of the page
UNSEEN = frozenset("script style noscript template iframe svg math object head title canvas audio video".split())
#: elements whose content is not markup, up to their end tag
RAW = frozenset("script style textarea title iframe noscript".split())
#: elements that a start tag ends where they are still open, up to the nearest of the second set
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ENDS_P = BLOCKS - {"option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}

#: elements that may stand in a head; any other start tag, or text, ends it
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
#: elements of another language, in which a slash does end a start tag
FOREIGN = ("svg", "math")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TURN = re.compile(r"""[>"']""")
#: where the content of an element that holds no markup ends
_RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I) for tag in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LETTERS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Path:
    """An element and its ancestors; equal paths are one object, so that features can be kept."""

    __slots__ = ("parent", "tag", "names", "below", "unseen", "linked", "holder", "known", "marks", "features")

    def __init__(self, parent: Path | None, tag: str, names: tuple[str, ...]):
        self.parent, self.tag, self.names = parent, tag, names
        self.below: dict[tuple[str, str], Path] = {}
        self.unseen: bool = tag in UNSEEN or bool(parent and parent.unseen)
        self.linked: bool = tag == "a" or bool(parent and parent.linked)
        #: the nearest block element, itself included
        self.holder: Path = self if parent is None or tag in BLOCKS else parent.holder
        #: tags and names of the path, each once; shared with the parent where nothing is new
        own = [f"in={tag}"] * bool(tag) + [f"name={x}" for x in names]
        self.known: frozenset[str] = parent.known if parent else frozenset()
        self.marks: tuple[str, ...] = parent.marks if parent else ()
        if new := [x for x in dict.fromkeys(own) if x not in self.known]:
            self.known, self.marks = self.known.union(new), (*self.marks, *new)
        #: what the path adds to a block's score, once it has been computed
        self.features: float | None = None

    def child(self, tag: str, attributes: str) -> Path:
        key = (tag, attributes if "=" in attributes and tag in BLOCKS | {"span"} else "")
        if key not in self.below:
            names: list[str] = []
            for m in _NAMES.finditer(key[1]):
                names += _LETTERS.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower())
            if len(self.below) > 2000:
                self.below.clear()
            self.below[key] = Path(self, tag, tuple(dict.fromkeys(names)))
        return self.below[key]


@dataclass(slots=True)
class Block:
    text: str
    path: Path
    linked: int


class Marks:
    """Tags, comments and declarations of a page, one after another, in time linear in its length.

    What has once been looked for in vain up to the end of the page is not looked for again: a ``>``,
    a quote of either kind, and the end of a tag behind a quote.
    """

    def __init__(self, page: str):
        self.page = page
        self._last = {q: page.rfind(q) for q in (">", '"', "'")}
        #: quotes outside of which no ``>`` follows
        self._endless: set[int] = set()

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, tag, whether it is an end tag, and attributes; the tag is empty for others."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", False, ""
            if start > self._last[">"]:  # only a comment may still come
                at = page.find("<!--", start)
                if at < 0:
                    return None
                continue
            closing = page.startswith("/", start + 1)
            name = _NAME.match(page, start + 1 + closing)
            if name:
                end = self._tag_end(name.end())
                return start, end + 1, name[0].lower(), closing, page[name.end() : end]
            if page.startswith(("!", "?"), start + 1):
                return start, page.index(">", start) + 1, "", False, ""
            at = start + 1
        return None

    def _tag_end(self, at: int) -> int:
        """The ``>`` outside quotes; the next one at all where a quote is never closed."""
        page, opened, look = self.page, [], at
        while turn := _TURN.search(page, look):
            where, sign = turn.start(), turn[0]
            if sign == ">":
                return where
            opened.append(where)
            if where in self._endless or where >= self._last[sign]:
                break
            look = page.index(sign, where + 1) + 1
        self._endless.update(opened)
        return page.index(">", at)


class Open:
    """The open elements, innermost last, with the places of each kind."""

    def __init__(self, root: Path):
        self.stack = [root]
        self._places: dict[str, list[int]] = {}

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags; 0 if there is none."""
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=0)

    def push(self, path: Path) -> None:
        self._places.setdefault(path.tag, []).append(len(self.stack))
        self.stack.append(path)

    def cut(self, place: int) -> None:
        """End the element at a place and all that it holds."""
        while len(self.stack) > place > 0:
            self._places[self.stack.pop().tag].pop()

    def close(self, tags: set[str], limits: set[str], all_of_them: bool = False) -> None:
        """End the innermost open element of these tags, or all, up to the nearest limit."""
        while (place := self.last(tags)) > self.last(limits):
            self.cut(place)
            if not all_of_them:
                return


def blocks(page: str, root: Path) -> list[Block]:
    """The page's blocks that hold text, in order. White space in a block is one blank; trimmed.

    Pages of any length and with any errors in them take time in proportion to their length.
    """
    found: list[Block] = []
    parts: list[str] = []
    state = {"linked": 0, "path": root}
    elements = Open(root)
    stack = elements.stack

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, state["path"], state["linked"]))
            parts.clear()
        state["linked"] = 0

    def add(piece: str) -> None:
        """A block stands in the element of its first piece that is more than white space."""
        if not parts:
            if piece.isspace():
                return
            state["path"] = stack[-1].holder
        parts.append(piece)

    def see(piece: str) -> None:
        if stack[-1].tag == "head" and not piece.isspace():
            elements.cut(len(stack) - 1)
        if not stack[-1].unseen:
            add(piece)
            if stack[-1].linked:
                state["linked"] += len(piece.strip())

    # Marks are looked for from ``after``: behind ``at`` by the content of an element without markup.
    marks, at, after = Marks(page), 0, 0
    while mark := marks.next(after):
        start, end, tag, closing, attributes = mark
        if start > at:
            see(page[at:start])
        at = after = end
        if not tag:
            continue
        if tag in BLOCKS:
            end_block()
        elif tag == "br":
            add(" ")
        if closing:
            elements.cut(elements.last((tag,)))
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            elements.cut(len(stack) - 1)
        if tag in VOID:
            continue
        if tag in ENDS_P:
            elements.close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in IMPLIED:
            elements.close(*IMPLIED[tag], all_of_them=len(IMPLIED[tag][0]) > 1)
        if tag == "body":
            elements.close({"head"}, {"html"})
        if attributes.endswith("/") and (tag in FOREIGN or elements.last(FOREIGN)):
            continue
        elements.push(stack[-1].child(tag, attributes))
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            if not close:
                break
            after = close.start()
    if at < len(page):
        see(page[at:])
    end_block()
    return found

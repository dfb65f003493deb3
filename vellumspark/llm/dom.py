"""HTML read into a tree of block elements and text leaves, in one pass and without recursion."""

from __future__ import annotations

import html
import re
from collections import Counter

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("audio button canvas datalist map object select svg template video".split())
#: An open element that a new one closes, and where the search for it stops.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul".split(), (("p",), ("td", "th", "caption", "table"))),
}
ALSO = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody",), ("table",)), "tfoot": (("tbody", "thead"), ("table",))}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_UNFINISHED = re.compile("<[a-zA-Z/!?]")
_NAMED = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
NAMING = ("class", "id", "role", "itemprop")


class Tree:
    """Nodes in page order: ``parent`` (-1 for the root), ``tag`` ("" for text leaves),
    ``attributes`` as written, ``text`` and ``linked`` (its characters within links)."""

    def __init__(self) -> None:
        self.parent, self.tag, self.attributes, self.text, self.linked = [-1], ["html"], [""], [""], [0]

    def add(self, parent: int, tag: str, attributes: str = "", text: str = "", linked: int = 0) -> int:
        for column, value in zip((self.parent, self.tag, self.attributes, self.text, self.linked), (parent, tag, attributes, text, linked), strict=True):
            column.append(value)
        return len(self.tag) - 1


def names(attributes: str) -> list[str]:
    """Lower-case words of an element's class, id, role and itemprop."""
    if "=" not in attributes:
        return []
    found = []
    for m in _NAMED.finditer(attributes):
        if m[1].lower() in NAMING:
            found += [w.lower() for w in _WORD.findall(html.unescape(m[2] or m[3] or m[4] or ""))]
    return found


def parse(page: str) -> Tree:
    """Unclosed and misnested elements are closed as the standard implies; text between two
    block boundaries is one leaf, its references decoded and its white space single."""
    tree = Tree()
    stack, opened = [(0, "html", False)], Counter()
    said: list[str] = []
    linked, link_depth = 0, 0

    def flush() -> None:
        nonlocal linked
        if said:
            text = " ".join("".join(said).split())
            if text:
                tree.add(stack[-1][0], "", text=text, linked=min(linked, len(text)))
            said.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal link_depth
        flush()
        while len(stack) > to:
            opened[stack.pop()[1]] -= 1
        if link_depth > len(stack):
            link_depth = 0

    def close(which: tuple[str, ...], stops: tuple[str, ...]) -> None:
        if any(opened[w] for w in which):
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][1] in which:
                    return pop(at)
                if stack[at][1] in stops:
                    return None

    def hear(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1][2]:
            piece = html.unescape(piece) if "&" in piece else piece
            said.append(piece)
            if link_depth:
                linked += len(piece)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            hear(_UNFINISHED.split(page[at:], maxsplit=1)[0])
            break
        hear(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                link_depth = 0
            elif tag == "p" and not opened["p"]:
                flush()
            elif stack[-1][1] == tag and tag in UNSEEN:  # no block boundary
                stack.pop()
                opened[tag] -= 1
            elif opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] == tag:
                        pop(i)
                        break
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            last = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = last.start() if last else end
        elif tag == "br":
            hear(" ")
        elif tag == "a":
            link_depth = len(stack)
        elif tag in ("html", "body"):
            flush()
            if tag == "body" and attributes and not tree.attributes[0]:
                tree.attributes[0] = attributes
        elif tag in BLOCKS or tag in UNSEEN:
            if tag in BLOCKS:
                flush()
                for rule in (CLOSES.get(tag), ALSO.get(tag)):
                    if rule:
                        close(*rule)
            if tag not in VOID:
                hidden = stack[-1][2] or tag in UNSEEN
                if not attributes.rstrip().endswith("/") or tag in BLOCKS:
                    stack.append((tree.add(stack[-1][0], tag, attributes) if tag in BLOCKS else stack[-1][0], tag, hidden))
                    opened[tag] += 1
    flush()
    return tree

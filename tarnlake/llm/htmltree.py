"""HTML to a tree, leniently: unclosed, misplaced and cut-off tags still give a tree."""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: An opening tag of the second kind ends an open element of the first, unless a scope is in between.
ENDS = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "option": frozenset(("option", "optgroup")),
    "tr": frozenset(("tr", "tbody", "tfoot", "thead")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "head": frozenset(("body",)),
}
SCOPES = {"p": frozenset("table td th button caption".split()), "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table",)), "th": frozenset(("table",)), "option": frozenset(("select",)), "head": frozenset()}
#: Elements that a closing tag of something outside does not close.
HOLDS = frozenset("table td th article section main body html".split())

_MARKUP = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<other>[!?])[^>]*(?:>|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_TAG_PLAIN = re.compile(r"<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")


class Node:
    """An element: name, attributes, and children, which are nodes and strings."""

    __slots__ = ("children", "name", "rest")

    def __init__(self, name: str, rest: str = ""):
        self.name, self.rest, self.children = name, rest, []

    @property
    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.rest)} if self.rest else {}


#: By the name of an opening tag: the open elements that it ends, and those that protect them.
_ENDED_BY = {name: [x for x in ENDS if name in ENDS[x]] for name in frozenset().union(*ENDS.values())}
_GUARDS = {name: frozenset().union(*(SCOPES[x] for x in ended)) for name, ended in _ENDED_BY.items()}
#: Closing tags that go through what HOLDS.
_THROUGH = HOLDS | frozenset("tr tbody thead tfoot ul ol div form".split())


class _Open:
    """The open elements, innermost last, and where those of each name stand; each tag costs a fixed number of steps."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def last(self, names) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        out, places = 0, self.places
        for x in names:
            at = places.get(x)
            if at and at[-1] > out:
                out = at[-1]
        return out

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        for node in self.stack[at:]:
            self.places[node.name].pop()
        del self.stack[at:]

    def before(self, name: str) -> None:
        """End what an opening tag ends."""
        if ended := _ENDED_BY.get(name):
            while (at := self.last(ended)) and at >= self.last(_GUARDS[name]):
                self.cut(at)

    def close(self, name: str) -> None:
        at = self.last((name,))
        if at and (name in _THROUGH or at > self.last(HOLDS)):
            self.cut(at)


def parse(html: str) -> Node:
    """The root, named '', over all elements of the page. Time grows with the length of the page, however deep it nests."""
    root = Node("")
    tree = _Open(root)
    stack = tree.stack
    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            stack[-1].children.append(unescape(html[at:]))
            break
        m = _MARKUP.match(html, start)
        if m is None:
            m = _TAG_PLAIN.match(html, start)  # a quote that never ends
        if m is None:  # a "<" of the text, or the last character
            end = start + 1
            stack[-1].children.append(unescape(html[at:end]))
            at = end
            continue
        if start > at:
            stack[-1].children.append(unescape(html[at:start]))
        at = m.end()
        found = m.groupdict()
        if found.get("name") is None:
            continue
        name = found["name"].lower()
        if found["close"]:
            tree.close(name)
            continue
        tree.before(name)
        node = Node(name, found["rest"].strip())
        stack[-1].children.append(node)
        if name in VOID or found["rest"].endswith("/") and name not in RAW and (tree.last(("svg", "math"))):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            node.children.append(html[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        tree.push(node)
    return root

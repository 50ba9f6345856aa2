"""HTML to a tree of block elements and text blocks.

Scripts, styles, comments and other markup that is never text are left out.
Inline elements do not part a block; every block element does. Unclosed and
stray tags are taken as a browser would: a block start closes an open
paragraph, an item closes the item before it, and an end tag closes whatever
stands open inside it. A head ends at the first tag or text that cannot stand in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

# Element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style template noscript head title desc metadata iframe select option textarea datalist".split())
#: What may stand in a head; anything else ends one that is open.
HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCK = set(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of these names, up to the scope.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}


@dataclass
class Tree:
    """Nodes in page order; node 0 is the root. ``tag`` of a text block is '#'."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    names: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])
    keep: list[str | None] = field(default_factory=lambda: [None])


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree = Tree()
        self.open: list[tuple[str, int]] = [("#root", 0)]  # element, its block node
        self.hidden = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0

    def _node(self, tag: str, names: str, parent: int, text: str = "", linked: int = 0, keep: str | None = None) -> int:
        t = self.tree
        for column, value in zip((t.tag, t.names, t.parent, t.text, t.linked, t.keep), (tag, names, parent, text, linked, keep)):
            column.append(value)
        return len(t.tag) - 1

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self._node("#", "", self.open[-1][1], text, self.linked)
            self.parts, self.linked = [], 0

    def _close(self, depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        if any(tag in BLOCK for tag, _ in self.open[depth:]):
            self.flush()
        for tag, _ in self.open[depth:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD and tag != "body":
            self._end_head()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag in BLOCK:
                self.flush()
            return
        if tag in HIDDEN or self.hidden:
            if tag == "body" and self.hidden:  # a head that was never closed
                self._close(1)
            else:
                self.open.append((tag, self.open[-1][1]))
                self.hidden += tag in HIDDEN
                return
        if tag in BLOCK:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == "p":
                    self._close(k)
                    break
                if self.open[k][0] in BLOCK:
                    break
            if tag in ENDS:
                ended, scope = ENDS[tag]
                for k in range(len(self.open) - 1, 0, -1):
                    if self.open[k][0] in ended:
                        self._close(k)
                        break
                    if self.open[k][0] in scope:
                        break
            self.flush()
            given = dict(attrs)
            names = f"{given.get('class') or ''} {given.get('id') or ''} {given.get('role') or ''}"
            self.open.append((tag, self._node(tag, names, self.open[-1][1], keep=given.get("data-keep"))))
        else:
            self.links += tag == "a"
            self.open.append((tag, self.open[-1][1]))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return
            if tag not in BLOCK and tag not in HIDDEN and self.open[k][0] in BLOCK:
                return  # an inline end tag closes nothing outside its block

    def _end_head(self) -> None:
        if self.open[-1][0] == "head":
            self._close(len(self.open) - 1)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def parse(html: str) -> Tree:
    builder = _Builder()
    cut = html.rfind("<")
    if cut > html.rfind(">") and (html[cut + 1 : cut + 2].isalpha() or html[cut + 1 : cut + 2] in ("/", "!", "?")):
        html = html[:cut]  # a tag that the page's end cuts off
    builder.feed(html)
    builder.close()
    builder.flush()
    return builder.tree

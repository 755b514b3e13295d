"""HTML as a tree: elements and texts, shadow roots that the page declares, and documents of inner frames."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

# HTML's own rules: elements without content, those that an element's start ends, and who can have a shadow root.
VOID = {"area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "tbody"}, "li": {"li"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p",
    "pre", "search", "section", "table", "ul",
}
HOSTS = {"article", "aside", "blockquote", "body", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "nav", "p", "section", "span"}


class Node:
    """An element, a text (``tag`` is empty), or the root of a document or shadow tree (``tag`` begins with #).

    ``parent`` stays within a tree; ``host`` is the element that a shadow root belongs to, ``shadow`` an element's root.
    """

    __slots__ = ("tag", "attrs", "text", "parent", "children", "shadow", "host")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None, text: str = ""):
        self.tag, self.attrs, self.text, self.parent = tag, attrs or {}, text, parent
        self.children: list[Node] = []
        self.shadow: Node | None = None
        self.host: Node | None = None
        if parent is not None:
            parent.children.append(self)

    @property
    def is_element(self) -> bool:
        return self.tag != "" and self.tag[0] != "#"

    @property
    def above(self) -> Node | None:
        """The parent element; above a shadow tree its host. Frames are not looked out of."""
        p = self.parent
        if p is not None and p.tag == "#shadow":
            return p.host
        return p if p is not None and p.is_element else None

    def lineage(self) -> Iterator[Node]:
        """The element and those above it."""
        at: Node | None = self if self.is_element else self.above
        while at is not None:
            yield at
            at = at.above

    @property
    def root(self) -> Node:
        at = self
        while at.parent is not None:
            at = at.parent
        return at

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.is_element]

    def within(self) -> Iterator[Node]:
        """All nodes below in the same tree, in order."""
        stack = self.children[::-1]
        while stack:
            at = stack.pop()
            yield at
            stack += at.children[::-1]

    def assigned(self) -> list[Node]:
        """Of a slot: the host's children that it shows. The first slot of a name has them; texts go to the nameless one."""
        root = self.root
        if root.tag != "#shadow":
            return []
        name = self.attrs.get("name", "")
        first = next(n for n in root.within() if n.tag == "slot" and n.attrs.get("name", "") == name)
        return [c for c in root.host.children if c.attrs.get("slot", "") == name] if first is self else []

    def slot(self) -> Node | None:
        """The slot that shows a child of a host."""
        p = self.parent
        if p is None or p.shadow is None:
            return None
        name = self.attrs.get("slot", "")
        return next((n for n in p.shadow.within() if n.tag == "slot" and n.attrs.get("name", "") == name), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.document = Node("#document")
        self.open = [self.document]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH and any(e.tag == "p" for e in self.open):
            inner = max(i for i, e in enumerate(self.open) if e.tag == "p")
            if not any(e.tag in ("button", "table", "td", "th", "caption", "template", "object") for e in self.open[inner:]):
                del self.open[inner:]
        while self.open[-1].tag in ENDS.get(tag, ()):
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        at = max((i for i, e in enumerate(self.open) if e.tag == tag), default=0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        Node("", None, self.open[-1], data)


def parse_tree(html: str) -> Node:
    """The document of static HTML, with the shadow roots that its templates declare."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    for node in [n for n in builder.document.within() if n.tag == "template" and n.attrs.get("shadowrootmode", "").lower() in ("open", "closed")]:
        host = node.parent
        if host is not None and host.is_element and host.shadow is None and (host.tag in HOSTS or "-" in host.tag):
            host.children.remove(node)
            node.tag, node.parent, node.host, host.shadow = "#shadow", None, host, node
    return builder.document


def inner_document(frame: Node) -> Node | None:
    """The document of an inner frame that the page itself holds; none if it is sandboxed away or stands elsewhere."""
    if frame.tag != "iframe" or "srcdoc" not in frame.attrs:
        return None
    if "sandbox" in frame.attrs and "allow-same-origin" not in frame.attrs["sandbox"].lower().split():
        return None
    return parse_tree(frame.attrs["srcdoc"])

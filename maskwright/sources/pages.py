"""HTML pages as lines with their block, table cell and meaning.

A page is read as it would be shown: shadow trees in place of their hosts' children, slots with what is assigned to them,
documents of inner frames that the page holds, and nothing that style sheets or attributes hide. Meaning, table cells and
blocks are looked up from an element to those above it, out of shadow trees but not out of frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..cluster import ship, wide_rows
from .html_tree import Node, inner_document, parse_tree
from .styles import Styles, shown

PLACE = {"line_id": pa.int32(), "semantic": pa.string(), "kind": pa.string(), "table_id": pa.int32(), "col": pa.int32()}
LINE_SCHEMA = "page_id long, block_id int, line_id int, semantic string, kind string, table_id int, col int, text string"
BLOCK_SCHEMA = "page_id long, block_id int, units array<string>, line array<struct<line_id: int, semantic: string, kind: string, table_id: int, col: int>>"
OPAQUE_SCHEMA = "page_id long, ord int, tag string, w double, h double"
#: Rows of pages that a task holds before it passes them on.
ROWS = 2048
#: Attribute by which a page says what is expected of a text: mask or keep.
CHECK = "data-check"

# Results depend on them.
SKIP = {"script", "style", "noscript", "template", "head"}
LABEL_TAGS = {"th", "label", "caption", "legend", "button", "summary", "nav", "h1", "h2", "h3", "h4", "h5", "h6"}
DATA_TAGS = {"td", "output"}
LABEL_ROLES = {"button", "columnheader", "rowheader", "heading", "tab", "navigation", "menu", "menubar", "menuitem"}
DATA_ROLES = {"cell", "gridcell", "row"}
UNREADABLE = {"img", "canvas", "svg", "video", "picture"}
FRAMES = {"iframe", "frame", "object", "embed"}
IGNORED_INPUTS = {"checkbox", "radio", "hidden", "range", "color", "file", "image"}
BUTTON_INPUTS = {"button", "submit", "reset"}
PASSWORD = "●●●"


def meaning(node: Node) -> tuple[str | None, str | None]:
    """What an element stands for, by itself or the nearest above it: (label or data, tag or role). Roles are taken as
    they are written; of one element a label counts before data."""
    for e in node.lineage():
        role = e.attrs.get("role")
        if e.tag in LABEL_TAGS:
            return "label", e.tag
        if role in LABEL_ROLES:
            return "label", role
        if e.tag in DATA_TAGS:
            return "data", e.tag
        if role in DATA_ROLES:
            return "data", role
    return None, None


def row_cell(element: Node) -> tuple[Node, Node] | None:
    """The row that an element stands in, and the row's child that holds it."""
    cell, row = element, element.above
    while row is not None:
        if row.tag == "tr" or row.attrs.get("role") == "row":
            return row, cell
        cell, row = row, row.above
    return None


def column(cell: Node) -> int:
    """Cells before this one in its row; of other elements, elements before it."""
    beside = cell.parent.elements() if cell.parent is not None else [cell]
    if cell.tag in ("td", "th") and cell.parent is not None and cell.parent.tag == "tr":
        beside = [e for e in beside if e.tag in ("td", "th")]
    return beside.index(cell)


def chosen(select: Node) -> str:
    """What a list shows: its marked options; a list of one choice has the last of these, or its first that can be chosen."""
    options = [n for n in select.within() if n.tag == "option"]
    marked = [o for o in options if "selected" in o.attrs]
    if "multiple" not in select.attrs:
        marked = marked[-1:] or [o for o in options if "disabled" not in o.attrs][:1]
    return " ".join(o.attrs.get("label") or " ".join("".join(n.text for n in o.within()).split()) for o in marked)


class Page:
    """The visible lines of a page, one for each text and form value, and its unreadable elements."""

    def __init__(self, html: str):
        self.rows: list[dict] = []
        self.opaque: list[dict] = []
        self.ids: dict[str, dict[Node | None, int]] = {"block": {}, "table": {}}
        self.styles = Styles()
        self.fresh = True  # whether a space would stand at the start of a line
        self.read: dict | None = None  # the text of this line that was read last
        document = parse_tree(html)
        # what is still to be visited: a node with the element that shows it and its tree's root; None ends a line
        self.ahead: list[tuple[Node, Node | None, Node] | None] = []
        self._visit_all(document.children, None, document)
        while self.ahead:
            step = self.ahead.pop()
            self._new_line() if step is None else self._visit(*step)
        self._new_line()

    def _visit_all(self, nodes: list[Node], parent: Node | None, root: Node) -> None:
        self.ahead += [(n, parent, root) for n in reversed(nodes)]

    def _visit(self, node: Node, parent: Node | None, root: Node) -> None:
        if not node.is_element:
            self._text(node, root)
            return
        if node.tag in SKIP:
            return
        style = self.styles.of(node, parent, root)
        if not shown(style) and style["display"] != "contents":
            return
        if node.tag == "br" or not style["display"].startswith(("inline", "contents", "ruby")):
            self._new_line()
            self.ahead.append(None)
        if node.tag in UNREADABLE:
            self._unreadable(node, node.tag)
        elif node.tag in FRAMES:
            inner = inner_document(node)
            if inner is None:
                self._unreadable(node, "frame")
            else:
                self._new_line()
                self.ahead.append(None)
                self._visit_all(inner.children, None, inner)
        elif node.tag in ("input", "textarea", "select"):
            self._value(node, root)
        elif style["content"] != "hidden":
            self._below(node, root)

    def _below(self, node: Node, root: Node) -> None:
        """What an element shows inside: a slot what is assigned to it, a host its shadow tree."""
        if node.tag == "slot":
            assigned = node.assigned()
            outer = root.host.root if assigned else root
            self._visit_all(assigned or node.children, node, outer)
        elif node.shadow is not None:
            self._visit_all(node.shadow.children, node, node.shadow)
        elif node.tag == "details" and "open" not in node.attrs:
            self._visit_all([c for c in node.children if c.tag == "summary"][:1], node, root)
        else:
            self._visit_all(node.children, node, root)

    def _unreadable(self, node: Node, tag: str) -> None:
        sides = [float(a) if (a := node.attrs.get(side, "")).replace(".", "", 1).isdigit() else None for side in ("width", "height")]
        self.opaque.append({"ord": len(self.opaque), "tag": tag, "w": sides[0], "h": sides[1]})

    def _number(self, what: str, owner: Node | None) -> int:
        return self.ids[what].setdefault(owner, len(self.ids[what]))

    def _block(self, element: Node | None, root: Node) -> int:
        for e in element.lineage() if element is not None else ():
            display = self.styles.held[e]["display"] if e in self.styles.held else "block"
            if not display.startswith("inline") and display != "contents":
                return self._number("block", e)
        return self._number("block", root)

    def _cell(self, element: Node | None) -> tuple[int | None, int | None]:
        found = row_cell(element) if element is not None else None
        if found is None:
            return None, None
        row, cell = found
        table, at = None, row.parent if row.tag == "tr" else None
        while at is not None and table is None:
            table, at = (at if at.tag == "table" else None), at.parent
        return self._number("table", table or row.above), column(cell)

    def _emit(self, element: Node | None, root: Node, text: str, said: tuple[str | None, str | None]) -> None:
        block = self._block(element, root)
        table, col = self._cell(element)
        check = next((e.attrs[CHECK] for e in element.lineage() if CHECK in e.attrs), None) if element is not None else None
        self.rows.append({"block_id": block, "line_id": len(self.rows), "semantic": said[0], "kind": said[1], "table_id": table, "col": col, "text": text, "check": check})

    def _new_line(self) -> None:
        if self.read is not None:
            self.read["text"] = self.read["text"].rstrip()
        self.fresh, self.read = True, None

    def _text(self, node: Node, root: Node) -> None:
        data = node.text
        text, before = " ".join(data.split()), "" if self.read is None else self.read["text"]
        if text:
            start = " " if data[0].isspace() and not self.fresh and not before.endswith(" ") else ""
            element = node.above
            self._emit(element, root, start + text + (" " if data[-1].isspace() else ""), meaning(element) if element is not None else (None, None))
            self.fresh, self.read = False, self.rows[-1]
        elif data and self.read is not None and not before.endswith(" "):
            self.read["text"] += " "

    def _value(self, node: Node, root: Node) -> None:
        """The value of a form's element, which is no text of the page. Passwords are never read out."""
        kind = node.attrs.get("type", "").lower() if node.tag == "input" else ""
        if kind in IGNORED_INPUTS:
            return
        if node.tag == "input":
            value = node.attrs.get("value", "")
            text = PASSWORD if kind == "password" and value else value
        else:
            text = chosen(node) if node.tag == "select" else "".join(n.text for n in node.within())
        if text.strip():
            name = f"input:{kind or 'text'}" if node.tag == "input" else node.tag
            self._emit(node, root, text, ("label" if kind in BUTTON_INPUTS else "data", name))
            self.fresh, self.read = False, None


def parse_page(html: str) -> Page:
    return Page(html)


def parse_html(html: str) -> list[dict]:
    """Visible lines of static HTML. Passwords are replaced; hidden inputs, scripts and styles give nothing."""
    return parse_page(html).rows


def _from_pages(pages: DataFrame, schema: str, build) -> DataFrame:
    """``build`` of each page's id and parsed HTML gives rows of ``schema``; null pages have none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(pages.sparkSession)
    wide_rows(pages.sparkSession)
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for batch in batches:
            rows: list[dict] = []
            for i in range(batch.num_rows):
                page_id, html = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if html:
                    rows += [{"page_id": page_id} | r for r in build(parse_page(html))]
                if len(rows) >= ROWS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                    rows = []

    return pages.select("page_id", "html").mapInArrow(run, kind)


def page_lines(pages: DataFrame, checks: bool = False) -> DataFrame:
    """``pages`` (``page_id, html``) as lines: ``LINE_SCHEMA``, and with ``checks`` the ``check`` that the page expects of
    each. Null pages have none, other columns are ignored."""
    return _from_pages(pages, LINE_SCHEMA + (", check string" if checks else ""), lambda page: page.rows)


def page_opaque(pages: DataFrame) -> DataFrame:
    """Elements whose content cannot be read, in order, with the sizes that their attributes give: ``OPAQUE_SCHEMA``."""
    return _from_pages(pages, OPAQUE_SCHEMA, lambda page: page.opaque)


def page_blocks(pages: DataFrame) -> DataFrame:
    """The lines of ``page_lines`` by block: the texts in order as ``units``, and where each stands as ``line``."""

    def blocks(page: Page) -> list[dict]:
        held: dict[int, list[dict]] = {}
        for r in page.rows:
            held.setdefault(r["block_id"], []).append(r)
        return [{"block_id": b, "units": [r["text"] for r in rows], "line": [{c: r[c] for c in PLACE} for r in rows]} for b, rows in held.items()]

    return _from_pages(pages, BLOCK_SCHEMA, blocks)

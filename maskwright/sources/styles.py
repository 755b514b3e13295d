"""Style sheets of a page: which elements are laid out, and whether within a line.

Rules are indexed by the id, class or tag of their last compound, so an element meets few of them. Of the declarations
that match, important ones win, then those of ``style`` attributes, then by specificity, then the later. Sheets that
pages load from elsewhere are not known; neither are the states of a pointer, so pseudo-classes but those named here
match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from .html_tree import Node

#: What is read of a declaration; the width in pixels that media rules are held against.
PROPERTIES, WIDTH = ("display", "visibility", "opacity", "position", "float", "content-visibility"), 1280
# HTML's own style sheet, as far as it tells lines and blocks apart.
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "button", "cite", "code", "em", "font", "i", "img", "input", "kbd", "label", "mark", "meter", "output", "progress", "q", "s", "samp", "select", "small", "span", "strong", "sub", "sup", "svg",
    "textarea", "time", "u", "var", "wbr", "acronym", "audio", "big", "canvas", "data", "del", "dfn", "embed", "iframe", "ins", "map", "nobr", "object", "picture", "rt", "ruby", "strike", "tt", "video",
}
NOT_LAID_OUT = {"area", "base", "datalist", "head", "link", "meta", "noscript", "param", "rp", "script", "style", "template", "title"}
_PIECE = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|[{};]|[^{};\"'/]+|/", re.S)
_SIMPLE = re.compile(r"\*|#[\w-]+|\.[\w-]+|\[[^\]]+\]|::?[a-z-]+(?:\((?:[^()]|\([^()]*\))*\))?|[a-zA-Z][\w-]*")
_ATTRIBUTE = re.compile(r"\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]+))\s*)?(?:\s+[iIsS])?\s*\]")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


@dataclass(frozen=True)
class Compound:
    """Simple selectors on one element; ``key`` is what it is looked up by."""

    simple: tuple[str, ...]

    @property
    def key(self) -> str:
        for kind in "#.":
            for s in self.simple:
                if s[0] == kind:
                    return s
        return next((s.lower() for s in self.simple if s[0].isalpha()), "*")

    def matches(self, node: Node) -> bool:
        return all(_holds(s, node) for s in self.simple)


@dataclass(frozen=True)
class Selector:
    """Compounds from the last to the first, each with what binds it to the one after it in the page's order."""

    compounds: tuple[tuple[str, Compound], ...]
    specificity: tuple[int, int, int]

    def matches(self, node: Node, at: int = 0) -> bool:
        if not self.compounds[at][1].matches(node):
            return False
        if at + 1 == len(self.compounds):
            return True
        binds = self.compounds[at + 1][0]
        return any(self.matches(n, at + 1) for n in _bound(node, binds))


def _bound(node: Node, binds: str) -> Iterator[Node]:
    """Elements of the same tree to which a combinator may lead."""
    if binds in "+~":
        before = node.parent.elements() if node.parent is not None else []
        before = before[: before.index(node)] if node in before else []
        yield from before[-1:] if binds == "+" else reversed(before)
        return
    p = node.parent
    while p is not None and p.is_element:
        yield p
        if binds == ">":
            return
        p = p.parent


def _holds(simple: str, node: Node) -> bool:
    if simple == "*":
        return True
    if simple[0] == "#":
        return node.attrs.get("id") == simple[1:]
    if simple[0] == ".":
        return simple[1:] in node.attrs.get("class", "").split()
    if simple[0] == "[":
        return _has_attribute(simple, node)
    if simple[0] == ":":
        return _is_so(simple, node)
    return node.tag == simple.lower()


def _has_attribute(simple: str, node: Node) -> bool:
    m = _ATTRIBUTE.fullmatch(simple)
    if m is None or m[1].lower() not in node.attrs:
        return False
    has, want = node.attrs[m[1].lower()], next((g for g in m.groups()[2:] if g is not None), "")
    return {
        None: True, "=": has == want, "~=": bool(want) and want in has.split(), "|=": has == want or has.startswith(want + "-"),
        "^=": bool(want) and has.startswith(want), "$=": bool(want) and has.endswith(want), "*=": bool(want) and want in has,
    }[m[2]]


def _is_so(pseudo: str, node: Node) -> bool:
    name, _, inside = pseudo[1:].partition("(")
    inside = inside[:-1]
    among = node.parent.elements() if node.parent is not None else [node]
    if name in ("not", "is", "where"):
        found = any(s.matches(node) for s in selectors(inside))
        return found != (name == "not")
    return {"first-child": among[:1] == [node], "last-child": among[-1:] == [node], "only-child": among == [node], "root": node.parent is not None and node.parent.tag == "#document", "empty": not node.children}.get(name, False)


def _apart(text: str, by: str = ",") -> list[str]:
    """``text`` parted at a character outside brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "([") - (c in ")]")
        if c == by and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def selectors(text: str) -> list[Selector]:
    """The selectors of a list; those that cannot be read are left out."""
    return [s for s in map(_selector, _apart(text)) if s is not None]


def _selector(text: str) -> Selector | None:
    text, at, binds, found, weight = text.strip(), 0, "", [], [0, 0, 0]
    while at < len(text):
        simple = []
        while m := _SIMPLE.match(text, at):
            if simple and (m[0][0].isalpha() or m[0] == "*"):
                return None
            simple.append(m[0])
            at = m.end()
        if not simple:
            return None
        found.append((binds, Compound(tuple(simple))))
        for s in simple:
            _weigh(s, weight)
        m = _COMBINATOR.match(text, at)
        if m is None:
            if at < len(text):
                return None
            break
        binds, at = m[1] or " ", m.end()
    # each compound goes with the combinator that stands before the next
    turned, after = [], ""
    for before, compound in reversed(found):
        turned.append((after, compound))
        after = before
    return Selector(tuple(turned), tuple(weight)) if found else None


def _weigh(simple: str, weight: list[int]) -> None:
    name, _, inside = simple.lstrip(":").partition("(")
    if simple[0] == ":" and name in ("not", "is", "where", "host") and inside:
        most = max((s.specificity for s in selectors(inside[:-1])), default=(0, 0, 0)) if name != "where" else (0, 0, 0)
        for i, n in enumerate(most):
            weight[i] += n
        weight[1] += name == "host"
    elif simple != "*":
        weight[0 if simple[0] == "#" else 2 if simple[0].isalpha() or simple[:2] == "::" else 1] += 1


def declarations(text: str) -> dict[str, tuple[bool, str]]:
    """Property -> (important, value), of those that are read; the last valid one of a property counts."""
    out: dict[str, tuple[bool, str]] = {}
    for part in _apart(re.sub(r"/\*.*?(?:\*/|\Z)", "", text, flags=re.S), ";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        important = value.endswith("important") and "!" in value
        value = " ".join(value.rpartition("!")[0].split()) if important else " ".join(value.split())
        if name in PROPERTIES and value and not (name in out and out[name][0] and not important):
            out[name] = important, value
    return out


def _applies(media: str) -> bool:
    """Whether a list of media queries holds on a screen of ``WIDTH`` pixels; what is not known does not."""
    for query in _apart(media.lower()):
        parts = [p.strip() for p in query.split(" and ")]
        good = True
        for p in parts:
            m = re.fullmatch(r"\(\s*(min|max)-width\s*:\s*([\d.]+)px\s*\)", p)
            good = good and (p in ("", "all", "screen", "only screen") if m is None else (WIDTH >= float(m[2])) == (m[1] == "min") or WIDTH == float(m[2]))
        if good:
            return True
    return False


def rules(css: str) -> Iterator[tuple[str, dict[str, tuple[bool, str]]]]:
    """(selector list, declarations) of a sheet in order. Of nested blocks, those of media that apply are read."""
    pieces = [m[0] for m in _PIECE.finditer(css) if not m[0].startswith("/*")]
    at, said = 0, ""
    while at < len(pieces):
        piece = pieces[at]
        at += 1
        if piece == "{":
            depth, start = 1, at
            while at < len(pieces) and depth:
                depth += (pieces[at] == "{") - (pieces[at] == "}")
                at += 1
            block, said = "".join(pieces[start : at - (depth == 0)]), said.strip()
            if said.startswith("@media"):
                if _applies(said[6:]):
                    yield from rules(block)
            elif said.startswith("@layer"):
                yield from rules(block)
            elif not said.startswith("@"):
                found = declarations(block)
                if found:
                    yield said, found
            said = ""
        elif piece in ";}":
            said = ""
        else:
            said += piece


class Sheet:
    """The rules of one tree's style elements, by key; those for the host and for slotted children apart."""

    def __init__(self, root: Node):
        self.by_key: dict[str, list[tuple[Selector, int, dict]]] = {}
        self.host: list[tuple[Compound | None, int, dict]] = []
        self.slotted: list[tuple[Selector, int, dict]] = []
        n = 0
        for node in root.within():
            if node.tag == "style" and _applies(node.attrs.get("media", "")):
                for text, found in rules("".join(c.text for c in node.children)):
                    for one in _apart(text):
                        n += 1
                        self._add(one.strip(), n, found)

    def _add(self, text: str, n: int, found: dict) -> None:
        host, slotted = re.fullmatch(r":host(?:\((.*)\))?", text, re.S), re.fullmatch(r"(?:slot)?::slotted\((.*)\)", text, re.S)
        if host is not None:
            inside = selectors(host[1])[:1] if host[1] else []
            if inside or not host[1]:
                self.host.append((inside[0] if inside else None, n, found))
        elif slotted is not None:
            self.slotted += [(s, n, found) for s in selectors(slotted[1])]
        else:
            for s in selectors(text):
                self.by_key.setdefault(s.compounds[0][1].key, []).append((s, n, found))

    def matching(self, node: Node) -> Iterator[tuple[tuple[int, int, int], int, dict]]:
        keys = ["*", node.tag, *(f".{c}" for c in set(node.attrs.get("class", "").split()))]
        if "id" in node.attrs:
            keys.append(f"#{node.attrs['id']}")
        for key in keys:
            for selector, n, found in self.by_key.get(key, ()):
                if selector.matches(node):
                    yield selector.specificity, n, found


class Styles:
    """Computed values of a page's elements, each found once."""

    def __init__(self):
        self.sheets: dict[Node, Sheet] = {}
        self.held: dict[Node, dict[str, str]] = {}

    def _sheet(self, root: Node) -> Sheet:
        if root not in self.sheets:
            self.sheets[root] = Sheet(root)
        return self.sheets[root]

    def declared(self, node: Node, root: Node) -> dict[str, str]:
        """The winning declarations of the page on an element."""
        best: dict[str, tuple[tuple, str]] = {}

        def offer(layer: int, specificity: tuple, n: int, found: dict) -> None:
            for name, (important, value) in found.items():
                # important declarations of an inner tree win over those of the outer one
                rank = (important, -layer if important and layer < 2 else layer, specificity, n)
                if name not in best or rank > best[name][0]:
                    best[name] = rank, value

        if node.shadow is not None:
            for selector, n, found in self._sheet(node.shadow).host:
                if selector is None or selector.matches(node):
                    offer(0, (0, 1, 0), n, found)
        slot = node.slot()
        if slot is not None:
            for selector, n, found in self._sheet(slot.root).slotted:
                if selector.matches(node):
                    offer(0, selector.specificity, n, found)
        for specificity, n, found in self._sheet(root).matching(node):
            offer(1, specificity, n, found)
        if node.attrs.get("style"):
            offer(2, (0, 0, 0), 0, declarations(node.attrs["style"]))
        return {name: value for name, (_, value) in best.items()}

    def of(self, node: Node, parent: Node | None, root: Node) -> dict[str, str]:
        """``display``, ``visibility`` and ``opacity`` as they are used. ``parent`` is the element that shows this one: its
        own, the slot it is assigned to, or the host; ``root`` that of its tree."""
        if node in self.held:
            return self.held[node]
        said, above = self.declared(node, root), self.held.get(parent, {}) if parent is not None else {}
        display = said.get("display", "")
        if display in ("", "initial", "unset", "revert", "inherit"):
            display = {"initial": "inline", "unset": "inline", "inherit": above.get("display", "block")}.get(display) or default_display(node)
        if display.startswith(("inline", "ruby")):
            placed = said.get("position") in ("absolute", "fixed") or said.get("float") in ("left", "right", "inline-start", "inline-end")
            if placed or above.get("inside", "") in ("flex", "inline-flex", "grid", "inline-grid"):
                display = {"inline": "block", "inline-block": "block"}.get(display, display.removeprefix("inline-"))
        visibility = said.get("visibility", "inherit")
        if visibility in ("inherit", "unset", "revert"):
            visibility = above.get("visibility", "visible")
        faint = _number(said.get("opacity", "1")) <= 0
        # children of an element without a box of its own lie in the box around it
        inside = above.get("inside", "") if display == "contents" else display
        found = {"display": display, "visibility": "visible" if visibility == "initial" else visibility, "opacity": "0" if faint else "1", "inside": inside, "content": said.get("content-visibility", "")}
        self.held[node] = found
        return found


def _number(value: str) -> float:
    try:
        return float(value.rstrip("%"))
    except ValueError:
        return 1.0


def default_display(node: Node) -> str:
    """HTML's own display of an element."""
    a = node.attrs
    if node.tag in NOT_LAID_OUT or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a):
        return "none"
    if node.tag == "slot":
        return "contents"
    return "inline" if node.tag in INLINE or "-" in node.tag else "block"


def shown(style: dict[str, str]) -> bool:
    """Whether an element is laid out and can be seen."""
    return style["display"] not in ("none", "contents") and style["visibility"] == "visible" and style["opacity"] != "0"

"""Corrections of masks by a reviewer, as joins of rectangles and as the state of a page."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..cluster import ship

#: A pointer that moves no farther than this clicks; a drag adds a mask if it is larger than this on both sides.
CLICK_REACH, DRAG_MIN = 4, 2
#: Sizes of tiles are powers of two up to this one.
LEVELS = 40


def overlaps(a: str, b: str) -> Column:
    """Strict overlap of two rectangles ``x, y, w, h`` under aliases."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x") < c(b, "x") + c(b, "w")) & (c(b, "x") < c(a, "x") + c(a, "w")) & (c(a, "y") < c(b, "y") + c(b, "h")) & (c(b, "y") < c(a, "y") + c(a, "h"))


def _level(w: Column, h: Column) -> Column:
    """The least power of two that both sides fit in."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(w, h, F.lit(1.0)))), F.lit(0)), F.lit(LEVELS)).cast("int")


def _levels(rects: DataFrame) -> list[int]:
    """The levels of a table's rectangles; at most ``LEVELS`` + 1 numbers, whatever its size."""
    return sorted(r[0] for r in rects.select(_level(F.col("w"), F.col("h"))).distinct().collect() if r[0] is not None)


def _dealt(rects: DataFrame, own: bool, levels: list[int]) -> DataFrame:
    """``rects`` once for each tile that they touch: of the tiles of their own size (``own``), or of each larger one of
    ``levels``. A rectangle is no larger than a tile, so it touches four at most of one size."""
    level = _level(F.col("w"), F.col("h"))
    sizes = F.array(level) if own else F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda s: s > level)
    tiles = lambda at, side: F.sequence(F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("level"))), F.floor((F.col(at) + F.col(side)) / F.pow(F.lit(2.0), F.col("level"))))
    sized = rects.select("*", F.explode(sizes).alias("level"))
    return sized.select("*", F.explode(tiles("x", "w")).alias("tile_x")).select("*", F.explode(tiles("y", "h")).alias("tile_y"))


TILE = ["page_id", "level", "tile_x", "tile_y"]


def _met(masks: DataFrame, others: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Both tables by tile, twice: masks among tiles of their own size with others no larger, and the other way round.

    Two rectangles meet in tiles of the size of the larger one. Equal sizes meet in the first pair.
    """
    of_masks, of_others = _levels(masks), _levels(others)
    below = _dealt(others, True, []).unionByName(_dealt(others, False, of_masks))
    return [(_dealt(masks, True, []), below), (_dealt(masks, False, of_others), _dealt(others, True, []))]


def _sided(rects: DataFrame, *keys: str) -> DataFrame:
    """Keys and sides as doubles; rectangles with a null side or of negative size are nowhere."""
    sides = rects.select(*keys, *(F.col(c).cast("double").alias(c) if c in rects.columns else F.lit(0.0).alias(c) for c in "xywh"))
    return sides.where("x IS NOT NULL AND y IS NOT NULL AND w >= 0 AND h >= 0")


def bulk_unmask(masks: DataFrame, drags: DataFrame) -> DataFrame:
    """``masks`` (``page_id, mask_id, x, y, w, h``) of a page that none of the page's ``drags`` overlaps.

    Rectangles are dealt to tiles and joined by page and tile, so a page of any size is spread over tasks; a mask is
    looked for until one drag overlaps it. Rows of one page and mask_id go together.
    """
    hit = None
    for own, other in _met(_sided(masks, "page_id", "mask_id"), _sided(drags, "page_id")):
        on = [F.col(f"m.{c}") == F.col(f"d.{c}") for c in TILE]
        found = own.alias("m").join(other.alias("d"), on + [overlaps("m", "d")], "left_semi").select("page_id", "mask_id")
        hit = found if hit is None else hit.unionByName(found)
    return masks.join(hit.distinct(), ["page_id", "mask_id"], "left_anti").select(masks.columns)


def click_unmask(masks: DataFrame, clicks: DataFrame) -> DataFrame:
    """``masks`` without the topmost (greatest ``mask_id``) that holds each click (``page_id, click_id, x, y``).

    A click is looked for in the one tile of each size that it lies in.
    """
    hit = None
    inside = F.col("c.x").between(F.col("m.x"), F.col("m.x") + F.col("m.w")) & F.col("c.y").between(F.col("m.y"), F.col("m.y") + F.col("m.h"))
    points = _sided(clicks.select("page_id", "click_id", "x", "y"), "page_id", "click_id")
    for own, other in _met(_sided(masks, "page_id", "mask_id"), points):
        on = [F.col(f"m.{c}") == F.col(f"c.{c}") for c in TILE]
        found = own.alias("m").join(other.alias("c"), [*on, inside]).select("c.page_id", "c.click_id", "m.mask_id")
        hit = found if hit is None else hit.unionByName(found)
    top = hit.groupBy("page_id", "click_id").agg(F.max("mask_id").alias("mask_id")).select("page_id", "mask_id").distinct()
    return masks.join(top, ["page_id", "mask_id"], "left_anti").select(masks.columns)


def column_components(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which intervals hang together: a number for each, the least place of its component.

    Two hang together if they share half of the narrower or more. They do if, and only if, the wider holds the middle
    of the narrower: so the widest go first, and each one joins all wider ones that hold its middle. Those lie in the
    nodes of a tree of places on the way to it; once joined, a node keeps one of them. Intervals without width are alone.
    """
    n = len(x)
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    middles = x + w / 2
    places = np.unique(middles)
    size = 1 << max(len(places) - 1, 0).bit_length()
    lows, highs = np.searchsorted(places, x, "left").tolist(), np.searchsorted(places, x + w, "right").tolist()
    leaves, wide = np.searchsorted(places, middles).tolist(), w > 0
    held: list[list[int]] = [[] for _ in range(2 * size)]
    for i in np.lexsort((np.arange(n), -w)).tolist():
        if not wide[i]:
            continue
        # of equal width each holds the other's middle or neither does, so the later one finds the earlier
        node = leaves[i] + size
        while node:
            for j in held[node]:
                a, b = top(i), top(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if held[node]:
                held[node] = held[node][:1]
            node >>= 1
        low, high = lows[i] + size, highs[i] + size
        while low < high:
            if low & 1:
                held[low].append(i)
                low += 1
            if high & 1:
                high -= 1
                held[high].append(i)
            low, high = low >> 1, high >> 1
    return np.array([top(i) for i in range(n)], np.int64)


def column_members(masks: DataFrame, seeds: DataFrame) -> DataFrame:
    """``page_id, mask_id`` of all that column overlap (half of the narrower, or more) reaches from ``seeds``.

    One shuffle by page; a page is swept in time that grows with its masks and their logarithm. Seeds that are no masks
    are members by themselves, once. Null pages and masks are left out; masks of null sides reach nothing.
    """
    ship(masks.sparkSession)
    own = masks.where("page_id IS NOT NULL AND mask_id IS NOT NULL").select(F.col("page_id").cast("long"), F.col("mask_id").cast("long"), F.col("x").cast("double"), F.col("w").cast("double"))
    marked = seeds.where("page_id IS NOT NULL AND mask_id IS NOT NULL").select(F.col("page_id").cast("long"), F.col("mask_id").cast("long")).distinct()

    def run(key: tuple, page: pd.DataFrame, from_: pd.DataFrame) -> pd.DataFrame:
        ids = page.mask_id.to_numpy()
        x, w = (page[c].astype(float).fillna(0.0).to_numpy() for c in "xw")
        component = column_components(x, np.where(page.x.isna() | page.w.isna(), 0.0, w))
        reached = np.unique(component[np.isin(ids, from_.mask_id.to_numpy())])
        found = np.union1d(ids[np.isin(component, reached)], from_.mask_id.to_numpy()).astype(np.int64)
        return pd.DataFrame({"page_id": np.full(len(found), key[0], np.int64), "mask_id": found})

    return own.groupBy("page_id").cogroup(marked.groupBy("page_id")).applyInPandas(run, "page_id long, mask_id long")


REPLAYED = "page_id long, state string, ord long, x double, y double, w double, h double, source string, reason string, text string"


def gestures(pointer: DataFrame) -> DataFrame:
    """Pointer strokes (``page_id, seq, x0, y0, x1, y1, alt, shift``) as edits: ``page_id, seq, edit, x, y, w, h``.

    ``edit`` is ``click`` or ``column`` (with alt) at the stroke's end where it hardly moved, else ``bulk`` (with
    shift) or ``add`` over the stroke's rectangle; strokes too small to add anything are left out.
    """
    moved = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    small = moved <= CLICK_REACH
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    large = (w > DRAG_MIN) & (h > DRAG_MIN)
    edit = F.when(small & F.col("alt"), "column").when(small, "click").when(F.col("shift"), "bulk").when(large, "add")
    place = [F.when(small, F.col(f"{a}1")).otherwise(F.least(f"{a}0", f"{a}1")).alias(a) for a in "xy"]
    sides = [F.when(small, 0.0).otherwise(v).alias(n) for v, n in ((w, "w"), (h, "h"))]
    return pointer.select("page_id", "seq", edit.alias("edit"), *place, *sides).where("edit IS NOT NULL")


EDIT, MASK = "edit", "mask"
#: What a stream of a page's events holds: masks of its screen (``kind`` mask) and edits of them (``kind`` edit).
EVENTS = "page_id long, kind string, seq long, edit string, ord long, x double, y double, w double, h double, source string, reason string, text string"
_MASK, _EDIT = ("ord", "x", "y", "w", "h", "source", "reason", "text"), ("seq", "edit", "x", "y", "w", "h")


def _order(row: tuple) -> tuple:
    """By number, null first; of equal numbers by the values."""
    return row[0] is not None, row[0] or 0, str(row)


@dataclass
class PageEdits:
    """A page under edits: its masks from the bottom up, which of them are there, what was revealed and what is offered.

    Masks are kept in one list of rows; sides lie in arrays, and a taken mask is only marked. ``first`` and ``log`` are all
    that came, so that an edit which comes late can be put in its place.
    """

    first: list[tuple] = field(default_factory=list)
    log: list[tuple] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    sides: np.ndarray = field(default_factory=lambda: np.zeros((4, 0)))
    there: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    revealed: list[int] = field(default_factory=list)
    offered: int | None = None

    def take(self, masks: list[tuple], edits: list[tuple]) -> None:
        """Masks and edits that came; edits that are later than all before go on from what there is."""
        fresh = sorted(edits, key=_order)
        late = bool(masks) or (fresh and self.log and _order(fresh[0]) < _order(self.log[-1]))
        self.first += masks
        self.log = sorted(self.log + fresh, key=_order)
        if late:
            self.rows, self.revealed, self.offered = [], [], None
            self.sides, self.there = np.zeros((4, 0)), np.zeros(0, bool)
            self._lay(sorted(self.first, key=_order))
            fresh = self.log
        for e in fresh:
            self._apply(*e[1:])

    def _lay(self, masks: list[tuple]) -> None:
        self.rows += masks
        self.sides = np.hstack([self.sides, np.array([[np.nan if v is None else v for v in m[1:5]] for m in masks], float).reshape(-1, 4).T])
        self.there = np.append(self.there, np.ones(len(masks), bool))

    def _apply(self, edit: str, x: float, y: float, w: float, h: float) -> None:
        mx, my, mw, mh = self.sides
        if edit == "add":
            over = [m[0] for m, t in zip(self.rows, self.there.tolist(), strict=True) if t and m[0] is not None]
            self._lay([(max(over, default=-1) + 1, x, y, w, h, "manual", "manual", None)])
            return
        if edit == "bulk":
            gone = self.there & (mx < x + w) & (x < mx + mw) & (my < y + h) & (y < my + mh)
        else:
            holds = np.flatnonzero(self.there & (x >= mx) & (x <= mx + mw) & (y >= my) & (y <= my + mh))
            if not len(holds):
                return
            gone = np.zeros(len(self.rows), bool)
            gone[holds[-1]] = True
            if edit == "column":
                live = np.flatnonzero(self.there & ~np.isnan(mx + mw))
                component = column_components(mx[live], mw[live])
                gone[live[component == component[np.searchsorted(live, holds[-1])]]] = True
        if not gone.any():
            return
        self.there &= ~gone
        shown = [i for i in np.flatnonzero(gone).tolist() if self.rows[i][5] == "auto" and self.rows[i][7]]
        self.revealed += shown
        if edit != "click":
            self.offered = None
        elif shown:
            self.offered = shown[0]

    def result(self) -> Iterator[tuple]:
        """``state`` and mask of all that is left, revealed, and offered."""
        for i in np.flatnonzero(self.there).tolist():
            yield ("mask", *self.rows[i])
        for i in self.revealed:
            yield ("revealed", *self.rows[i])
        if self.offered is not None:
            yield ("offered", *self.rows[self.offered])

    def packed(self) -> str:
        return json.dumps([self.first, self.log, self.rows, self.there.tolist(), self.revealed, self.offered])

    @classmethod
    def unpacked(cls, text: str) -> PageEdits:
        first, log, rows, there, revealed, offered = json.loads(text)
        page = cls([tuple(m) for m in first], [tuple(e) for e in log], revealed=revealed, offered=offered)
        page._lay([tuple(m) for m in rows])
        page.there = np.array(there, bool)
        return page


def _plain(rows: pd.DataFrame, columns: tuple[str, ...]) -> list[tuple]:
    """Rows as tuples of plain values; what is missing is None."""
    lists = [[None if pd.isna(v) else v for v in rows[c].tolist()] for c in columns]
    return [tuple(int(v) if c in ("ord", "seq") and v is not None else v for c, v in zip(columns, row, strict=True)) for row in zip(*lists, strict=True)]


def _listed(page_id: int, page: PageEdits) -> pd.DataFrame:
    names = [c.split()[0] for c in REPLAYED.split(", ")]
    return pd.DataFrame([(page_id, state, *mask) for state, *mask in page.result()], columns=names)


def replay(masks: DataFrame, edits: DataFrame) -> DataFrame:
    """The masks of each page after its ``edits`` in the order of ``seq``: ``REPLAYED``.

    ``state`` is ``mask`` for what is left and added, ``revealed`` for automatic masks with a text that an edit took
    away, and ``offered`` for the text that the last such click proposes as a phrase. A click takes the topmost mask
    (the greatest ``ord``) that holds its point; ``column`` also all that are in its column; ``bulk`` all that its
    rectangle overlaps; ``add`` lays a mask of reason ``manual`` on top. Edits of pages without masks still add; edits
    of one ``seq`` go in the order of their values. Masks with a null side are never hit. A page is one screen, whose
    masks and edits one task holds.
    """
    ship(masks.sparkSession)

    def run(key: tuple, own: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        page = PageEdits()
        page.take(_plain(own, _MASK), _plain(log, _EDIT))
        return _listed(key[0], page)

    own = masks.select(*(F.col(c).cast("long") if c in ("page_id", "ord") else F.col(c).cast("double") if c in "xywh" else c for c in ("page_id", *_MASK)))
    log = edits.select(F.col("page_id").cast("long"), F.col("seq").cast("long"), "edit", *(F.col(c).cast("double") for c in "xywh"))
    return own.groupBy("page_id").cogroup(log.groupBy("page_id")).applyInPandas(run, REPLAYED)


def edit_events(masks: DataFrame, edits: DataFrame) -> DataFrame:
    """Masks and edits as one table or stream of ``EVENTS``."""
    names = {c.split()[0]: c.split()[1] for c in EVENTS.split(", ")}

    def shaped(rows: DataFrame, kind: str, own: tuple[str, ...]) -> DataFrame:
        value = lambda c: F.lit(kind) if c == "kind" else F.col(c) if c == "page_id" or c in own else F.lit(None)
        return rows.select(*(value(c).cast(t).alias(c) for c, t in names.items()))

    return shaped(masks, MASK, _MASK).unionByName(shaped(edits, EDIT, _EDIT))


def replay_stream(events: DataFrame) -> DataFrame:
    """A stream of ``EVENTS`` as the pages that it changes: ``REPLAYED`` with ``version``, for output mode ``update``.

    Each page is a state of its own: masks, what was revealed, what is offered, and the log. Whenever events of a page
    come, its rows are given anew under the next ``version``; the last version of a page is what ``replay`` gives of all
    that came, however it was split and in whatever order. Edits that come after later ones are put in their place. A
    page of which nothing is left gives one row of state ``none``.
    """
    ship(events.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, page = (state.get[0], PageEdits.unpacked(state.get[1])) if state.exists else (0, PageEdits())
        rows = pd.concat(list(batches), ignore_index=True)
        page.take(_plain(rows[rows.kind == MASK], _MASK), _plain(rows[rows.kind == EDIT], _EDIT))
        state.update((version + 1, page.packed()))
        out = _listed(key[0], page)
        if out.empty:
            out = pd.DataFrame([(key[0], "none", *[None] * 8)], columns=out.columns)
        yield out.assign(version=version + 1)

    return events.groupBy("page_id").applyInPandasWithState(run, f"{REPLAYED}, version long", "version long, page string", "update", GroupStateTimeout.NoTimeout)


def latest(versions: DataFrame) -> DataFrame:
    """Of the rows of ``replay_stream``, those of each page's last version, as ``replay`` gives them."""
    last = versions.groupBy(F.col("page_id").alias("_page")).agg(F.max("version").alias("_last"))
    newest = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("version") == F.col("_last"))
    return versions.join(last, newest, "left_semi").where("state <> 'none'").drop("version")

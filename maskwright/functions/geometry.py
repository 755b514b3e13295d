"""Boxes (``x0, y0, x1, y1``) and rectangles (``x, y, w, h``) as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def union(boxes: Column) -> Column:
    """The box around an array of boxes; null for none."""
    side = lambda take, n: take(F.transform(boxes, lambda b: b[n]))
    return F.when(F.size(boxes) > 0, box(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1")))


def around(a: Column, b: Column) -> Column:
    """The box around two boxes."""
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def shared_height(a: Column, b: Column) -> Column:
    """How far two boxes overlap from top to bottom; negative where they do not."""
    return F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])


def on_one_line(a: Column, b: Column) -> Column:
    """Whether two boxes share some height; boxes that are not known do."""
    return F.coalesce(shared_height(a, b) > 0, F.lit(True))


def to_rect(b: Column, padding: Column | float = 0.0, scale: Column | float = 1.0) -> dict[str, Column]:
    """``x, y, w, h`` of a box that was read at ``scale``, with ``padding`` on all sides."""
    return {"x": b["x0"] / scale - padding, "y": b["y0"] / scale - padding, "w": (b["x1"] - b["x0"]) / scale + padding * 2, "h": (b["y1"] - b["y0"]) / scale + padding * 2}


def outside(b: Column, width: Column, height: Column) -> Column:
    """Whether a box lies wholly beyond a screen; touching its edge is inside."""
    return (b["x1"] < 0) | (b["y1"] < 0) | (b["x0"] > width) | (b["y0"] > height)

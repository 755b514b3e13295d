"""Regions of a screen beside its text: what cannot be read, icons, decoration, the page's ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import COLOR, composite, to_hex, with_color
from ..functions.geometry import box, outside

# Sizes in CSS pixels, share of the screen, regions of a page.
OPAQUE_MIN, ICON_MIN, ICON_MAX, DECOR_MIN = 24, 8, 64, 6
DECOR_SHARE, DECOR_LIMIT, ICON_LIMIT = 0.8, 600, 200
OPAQUE_TAGS = ("img", "canvas", "svg", "video", "picture", "frame")
#: Characters of the private use area and white space only: drawings of an icon font.
GLYPHS = "^[\\x{E000}-\\x{F8FF}\\s]*[\\x{E000}-\\x{F8FF}][\\x{E000}-\\x{F8FF}\\s]*\\z"


def _bounds() -> Column:
    return box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))


def _seen(df: DataFrame) -> DataFrame:
    return df.where(~outside(_bounds(), F.col("screen_w"), F.col("screen_h")))


def _first(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first rows of each page in document order (``ord``)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    return df.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def drawn_text(text: Column) -> Column:
    """Whether a text is drawn by an icon font rather than read."""
    return F.coalesce(text.rlike(GLYPHS), F.lit(False))


def is_large(df: DataFrame) -> Column:
    return (F.col("w") >= OPAQUE_MIN) & (F.col("h") >= OPAQUE_MIN)


def opaque_masks(elements: DataFrame, keys: list[str], sx: Column | float = 1.0, sy: Column | float = 1.0) -> DataFrame:
    """Masks over elements that cannot be read (``tag`` of ``OPAQUE_TAGS``) and are large enough to tell something.

    ``elements`` has ``ord, tag, x, y, w, h, screen_w, screen_h``; ``sx, sy`` lead from its pixels to the picture's.
    """
    large = _seen(elements.where(F.col("tag").isin(*OPAQUE_TAGS) & is_large(elements)))
    rect = [(F.col(n) * s).alias(n) for n, s in (("x", sx), ("y", sy), ("w", sx), ("h", sy))]
    return large.select(*keys, "ord", *rect, F.lit("auto").alias("source"), F.concat(F.lit("opaque("), "tag", F.lit(")")).alias("reason"))


def _painted(elements: DataFrame) -> DataFrame:
    drawn = elements.withColumn("_border", F.when(F.col("border_width") > 0, F.col("border_color")))
    return with_color(with_color(drawn, "background_color", "bg"), "_border", "edge").drop("_border")


def is_ground() -> Column:
    """Whether an element is the page's ground: the root, the body, or one that covers the screen, in the top document."""
    covers = (F.col("x") <= 0) & (F.col("y") <= 0) & (F.col("x") + F.col("w") >= F.col("screen_w")) & (F.col("y") + F.col("h") >= F.col("screen_h"))
    return ~F.col("framed") & (F.col("tag").isin("html", "body") | covers)


def _decorated(elements: DataFrame) -> DataFrame:
    """``elements`` with their colours, and whether each is decoration (``decorates``)."""
    painted = _painted(elements)
    shown = (F.col("bg").isNotNull() | F.col("edge").isNotNull()) & (F.col("w") >= DECOR_MIN) & (F.col("h") >= DECOR_MIN)
    shown = shown & ~(F.col("bg").isNotNull() & is_ground() & F.col("edge").isNull())
    shown = shown & (F.col("w") * F.col("h") <= F.col("screen_w") * F.col("screen_h") * DECOR_SHARE)
    return painted.withColumn("decorates", F.coalesce(shown & ~outside(_bounds(), F.col("screen_w"), F.col("screen_h")), F.lit(False)))


def decor(elements: DataFrame, keys: list[str], limit: int = DECOR_LIMIT) -> DataFrame:
    """Boxes with a visible ground or border: ``keys, ord, x, y, w, h, bg_color, border_color``, the first of each page.

    ``elements`` has ``ord, tag, x, y, w, h, screen_w, screen_h, framed, background_color, border_color,
    border_width``. Slivers, boxes over most of the screen, and the page's own ground (unless it has a border) give none.
    """
    colors = [to_hex(F.col(c)).alias(n) for c, n in (("bg", "bg_color"), ("edge", "border_color"))]
    rows = _decorated(elements).where("decorates").drop("border_color")
    return _first(rows, keys, limit).select(*keys, "ord", "x", "y", "w", "h", *colors)


def icons(elements: DataFrame, keys: list[str], limit: int = ICON_LIMIT) -> DataFrame:
    """The page's icons in document order: small unreadable elements, glyphs, small pictures behind elements.

    ``elements`` has ``text, background_image`` beside the columns of ``decor``; ``kind`` is the tag, ``glyph`` or
    ``bg-image`` (first, where an element is both). Icons measure 8 to 64 pixels on both sides; a page gives at most
    ``limit``. Once a page has all its decoration, pictures behind elements count no more.
    """
    page = Window.partitionBy(*keys).orderBy("ord")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    # pages of no more elements than they may have boxes are not short of them, so their colours are not read
    many = F.count("*").over(page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > DECOR_LIMIT
    counted = elements.withColumn("_many", many)
    counted = counted.withColumns({c: F.when(F.col("_many"), F.col(c)) for c in ("background_color", "border_color")})
    rows = _decorated(counted).withColumn("decorated", F.coalesce(F.sum(F.col("decorates").cast("int")).over(before), F.lit(0)))
    small = F.col("tag").isin(*OPAQUE_TAGS) & ~is_large(elements)
    behind = F.when(F.col("background_image") & (F.col("decorated") < DECOR_LIMIT), "bg-image")
    own = F.when(small, F.col("tag")).when(drawn_text(F.col("text")), "glyph")
    fits = F.col("w").between(ICON_MIN, ICON_MAX) & F.col("h").between(ICON_MIN, ICON_MAX)
    kinds = F.posexplode(F.array_compact(F.array(behind, own))).alias("part", "kind")
    found = _seen(rows.where(fits)).select(*keys, "ord", "x", "y", "w", "h", kinds)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "part"))
    return found.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth", "part")


def page_ground(elements: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, page_background``: the grounds of each page laid over white, in document order."""
    grounds = _painted(elements).where(F.col("bg").isNotNull() & is_ground() & (F.col("w") >= DECOR_MIN) & (F.col("h") >= DECOR_MIN))
    layers = grounds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "bg"))).alias("layers"))
    white = F.struct(*(F.lit(v).alias(n) for v, n in ((255.0, "r"), (255.0, "g"), (255.0, "b"), (1.0, "a")))).cast(COLOR)
    below = F.aggregate("layers", white, lambda under, e: composite(e["bg"], under).cast(COLOR))
    pages = elements.select(*keys).distinct().join(layers, keys, "left")
    return pages.select(*keys, F.coalesce(to_hex(below), F.lit("#ffffff")).alias("page_background"))

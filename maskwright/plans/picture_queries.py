"""Registered queries over pictures of screens, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..cluster import kept
from ..operators.decide import decide, masks_of
from ..operators.spans import spread_units, with_spans
from ..sources.pictures import _by_page, _with, brightness_painted, encode
from ..sources.units import blocks_of, spread
from ..vocab import Rules
from . import oracle, samples

KEYS = ["conv_id", "turn"]
BACKGROUND, DARKEST, SHADES = 250, 60, 180


def screen_pictures(units):
    """``conv_id, turn, content``: a picture of each screen, its units as boxes of a colour by rule. Pictures differ in
    their filters."""
    s = F.col("conv_id") * 3 + F.col("turn") * 5 + F.col("unit_idx")
    rows = units.select(*KEYS, F.col("bbox.x0").alias("x"), F.col("bbox.y0").alias("y"), (DARKEST + s * 37 % SHADES).cast("int").alias("level"))

    def drawn(row):
        height = int(max(r["y"] for r in row["boxes"])) + samples.STEP_Y
        pixels = np.full((height, samples.ROW_UNITS * samples.STEP_X, 3), BACKGROUND, np.uint8)
        for r in row["boxes"]:
            x, y, level = int(r["x"]), int(r["y"]), r["level"]
            pixels[y : y + samples.UNIT_H, x : x + samples.UNIT_W] = level, level // 2, 255 - level
        return encode(pixels, ((0,), (1, 2), (2,), (3, 4, 1), (4, 0, 2))[row["conv_id"] % 5], level=1)

    return _with(_by_page(rows, KEYS, "boxes", "x", "y", "level"), "content", _parse_datatype_string("binary"), drawn, ("boxes",))


def painted_units(spark, sf_dir):
    """Brightness of every unit of a screen's picture before and after its masks are painted."""
    rules = Rules(terms=samples.SCREEN_TERMS)
    units = samples.screen_units(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    rows = spread_units(with_spans(blocks_of(units, KEYS), rules), along=("row",)).select("*", "row.*").drop("row")
    # both are read several times
    decided, pictures = kept(decide(rows, rules)), kept(screen_pictures(units))
    boxes = decided.select(*KEYS, F.col("unit_idx").alias("ord"), F.col("bbox.x0").alias("x"), F.col("bbox.y0").alias("y"), (F.col("bbox.x1") - F.col("bbox.x0")).alias("w"), (F.col("bbox.y1") - F.col("bbox.y0")).alias("h"))
    both = brightness_painted(pictures, masks_of(decided, KEYS, rules), boxes, KEYS)
    flags = decided.select(*KEYS, F.col("unit_idx").cast("long").alias("ord"), "mask")
    return both.join(flags, [*KEYS, "ord"]).select(*KEYS, F.col("ord").alias("unit_idx"), "mask", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


QUERIES = {"painted_units": painted_units}
_SCREEN = oracle.spans(oracle.SCREEN, samples.SCREEN_TERMS, oracle.V.LABELS, metric=True) + oracle.cascade()
_BEFORE = f"round((255 + ({DARKEST} + (k1 * 3 + k2 * 5 + unit_idx) * 37 % {SHADES}) // 2) / 3.0::DOUBLE, 6)"
ORACLE_SQL = {
    "painted_units": _SCREEN + f" SELECT k1 AS conv_id, k2 AS turn, unit_idx::BIGINT AS unit_idx, mask, {_BEFORE} AS before, CASE WHEN mask THEN 0.0::DOUBLE ELSE {_BEFORE} END AS after FROM decided",
}

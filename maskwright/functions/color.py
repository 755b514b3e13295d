"""CSS colours as native columns: parsing, compositing, hexadecimal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import once

COLOR = "struct<r: double, g: double, b: double, a: double>"

# Fixed values of the CSS colour specification: Oklab to LMS, LMS to linear sRGB, CIE XYZ (D50) to linear sRGB,
# linear Display P3 to linear sRGB.
OKLAB_LMS = ((1.0, 0.3963377773761749, 0.2158037573099136), (1.0, -0.1055613458156586, -0.0638541728258133), (1.0, -0.0894841775298119, -1.2914855480194092))
LMS_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
XYZ50_RGB = ((3.1341359569958707, -1.6173863321612538, -0.4906619460083532), (-0.978795502912089, 1.916254567259524, 0.03344273116131949), (0.07195537988411677, -0.2289768264158322, 1.405386058324125))
P3_RGB = ((1.2249401762805598, -0.2249401762805598, 0.0), (-0.0420569547096881, 1.0420569547096881, 0.0), (-0.0196375545903344, -0.0786360455506319, 1.0982736001409663))
WHITE50 = (0.9642956764295677, 1.0, 0.8251046025104602)


def _times(matrix, v: list[Column]) -> list[Column]:
    return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in matrix]


def _gamma(x: Column) -> Column:
    """A linear share of light, 0 to 1, as a value from 0 to 255."""
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055) * 255


def _linear(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def _rgba(rgb: list[Column], alpha: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip([*rgb, alpha], "rgba", strict=True)))


def with_color(df: DataFrame, source: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``r, g, b`` (0 to 255) and ``a`` (0 to 1) of the computed colour in ``source``.

    It is null where the colour is invisible or not known. Known are ``rgb() rgba() #rgb #rgba #rrggbb #rrggbbaa lab()
    lch() oklab() oklch() color(srgb ..)`` and ``color(display-p3 ..)``; numbers may be percentages, angles are in
    degrees. A column named ``out`` is replaced.
    """
    names = [c for c in df.columns if c != out]
    plain = F.lower(F.btrim(F.col(source)))
    # what a colour's form rules out is not looked for
    called, hexes = plain.contains("("), plain.startswith("#")
    space = F.when(plain.startswith("color("), F.regexp_extract(plain, "^color\\(\\s*([a-z0-9-]+)", 1)).otherwise("")
    forms = once(
        df,
        _plain=plain,
        _name=F.when(called, F.concat_ws(" ", F.regexp_extract(plain, "^([a-z]+)\\(", 1), space)),
        _parts=F.when(called, F.array_remove(F.split(F.regexp_extract(plain, "^[a-z]+\\(\\s*(?:srgb\\s|display-p3\\s)?([^)]*)\\)\\z", 1), "[\\s,/]+"), "")),
        _hex=F.when(hexes, F.when(plain.rlike("^#[0-9a-f]{3,4}\\z"), F.regexp_replace(plain, "([0-9a-f])", "$1$1")).when(plain.rlike("^#(?:[0-9a-f]{6}|[0-9a-f]{8})\\z"), plain)),
    )
    #: A percentage is a share of a whole that depends on the notation and the place.
    whole = {"rgb": (255.0,) * 3, "rgba": (255.0,) * 3, "oklab": (1.0, 0.4, 0.4), "oklch": (1.0, 0.4, 360.0), "lab": (100.0, 125.0, 125.0), "lch": (100.0, 150.0, 360.0)}
    notation = F.substring_index("_name", " ", 1)

    def number(i: int) -> Column:
        at = F.try_element_at("_parts", F.lit(i + 1))
        digits = F.regexp_extract(at, "^([+-]?[0-9.]+(?:e[+-]?[0-9]+)?)", 1).try_cast("double")
        share = F.lit(1.0)
        for name, wholes in whole.items() if i < 3 else ():
            share = F.when(notation == name, wholes[i]).otherwise(share)
        return F.when(at == "none", 0.0).when(at.endswith("%"), digits * share / 100).otherwise(digits)

    numbers = once(forms, **{f"_{i}": number(i) for i in range(4)})
    alpha = F.when(F.size("_parts") >= 4, F.least(F.greatest("_3", F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    is_ = lambda *names: F.col("_name").isin(*names)
    polar, turn = is_("oklch ", "lch "), F.radians("_2")
    placed = once(numbers, _alpha=alpha, _x=F.when(polar, F.col("_1") * F.cos(turn)).otherwise(F.col("_1")), _y=F.when(polar, F.col("_1") * F.sin(turn)).otherwise(F.col("_2")))
    # each notation's light by three values, then by a matrix as linear sRGB, then as values from 0 to 255
    light, x, y = F.col("_0"), F.col("_x"), F.col("_y")
    ok, lab, p3 = is_("oklab ", "oklch "), is_("lab ", "lch "), is_("color display-p3")
    fy = (light + 16) / 116
    roots = [F.when(ok, o).when(lab, c) for o, c in zip(_times(OKLAB_LMS, [light, x, y]), (fy + x / 500, fy, fy - y / 200), strict=True)]
    rooted = once(placed, **{f"_r{i}": v for i, v in enumerate(roots)})
    cube = [F.pow(f"_r{i}", F.lit(3.0)) for i in range(3)]
    back = [F.when(cube[i] > 216 / 24389, cube[i]).otherwise((F.col(f"_r{i}") * 116 - 16) / (24389 / 27)) * WHITE50[i] for i in range(3)]
    given = [F.col("_0"), x, y]
    lights = once(rooted, **{f"_l{i}": F.when(ok, cube[i]).when(lab, back[i]).when(p3, _linear(given[i])) for i in range(3)})
    three = [F.col(f"_l{i}") for i in range(3)]
    mixed = [F.when(ok, a).when(lab, b).when(p3, c) for a, b, c in zip(*(_times(m, three) for m in (LMS_RGB, XYZ50_RGB, P3_RGB)), strict=True)]
    linear = once(lights, **{f"_m{i}": F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))) for i, v in enumerate(mixed)})
    hexed = lambda i: F.conv(F.substring("_hex", i, 2), 16, 10).cast("double")
    is_hex = F.col("_hex").isNotNull()
    value = lambda i: F.when(is_hex, hexed(2 + 2 * i)).when(is_("rgb ", "rgba "), given[i]).when(is_("color srgb"), given[i] * 255).otherwise(_gamma(F.col(f"_m{i}")))
    opaque = F.when(is_hex, F.when(F.length("_hex") == 9, hexed(8) / 255).otherwise(1.0)).otherwise(F.col("_alpha"))
    colors = once(linear, _red=value(0), _green=value(1), _blue=value(2), _opaque=opaque)
    rgb = [F.col(c) for c in ("_red", "_green", "_blue")]
    seen = rgb[0].isNotNull() & rgb[1].isNotNull() & rgb[2].isNotNull() & (F.col("_opaque") > 0)
    return colors.withColumn(out, F.when(seen, _rgba(rgb, F.col("_opaque")))).select(*names, out)


def composite(front: Column, back: Column) -> Column:
    """A colour laid over an opaque one."""
    return _rgba([front[c] * front["a"] + back[c] * (1 - front["a"]) for c in "rgb"], F.lit(1.0))


def hex2(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.floor(value + 0.5).cast("long"))), 2, "0")


def to_hex(color: Column) -> Column:
    """``#rrggbb``, or ``#rrggbbaa`` where it is not opaque."""
    alpha = F.when(color["a"] < 1, hex2(color["a"] * 255)).otherwise("")
    return F.concat(F.lit("#"), hex2(color["r"]), hex2(color["g"]), hex2(color["b"]), alpha)

"""Pictures: written and read again, painted, measured."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.sources.pictures import SIGNATURE, brightness, brightness_of, brightness_painted, decode, decode_all, encode, filtered, mean_brightness, paint, painted, read_pictures, unfiltered

RNG = np.random.default_rng(7)


def _picture(height, width, channels):
    return RNG.integers(0, 256, (height, width, channels), np.uint8)


def _file(width, height, depth, kind, rows, interlaced=0, **more):
    part = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([depth, kind, 0, 0, interlaced])
    return SIGNATURE + part(b"IHDR", head) + b"".join(part(k.encode(), v) for k, v in more.items()) + part(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + part(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (4, 0, 3, 1, 2)])
def test_round_trip(channels, kinds):
    for shape in ((1, 1), (1, 9), (7, 1), (13, 11)):
        pixels = _picture(*shape, channels)
        assert (decode(encode(pixels, kinds)) == pixels).all()
    assert encode(pixels, kinds) == encode(pixels, kinds)


def _plainly(raw, kinds, step):
    """Filters as they are defined, byte after byte."""
    out = [[0] * len(raw[0]) for _ in raw]
    for r, line in enumerate(raw):
        for i, v in enumerate(line):
            a = out[r][i - step] if i >= step else 0
            b = out[r - 1][i] if r else 0
            c = out[r - 1][i - step] if r and i >= step else 0
            p = a + b - c
            near = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out[r][i] = (v + (0, a, b, (a + b) // 2, near)[kinds[r]]) % 256
    return out


def test_filters_by_definition():
    for step in (1, 2, 3, 4):
        for width in (step, step * 5, step * 5 + 1):
            raw, kinds = RNG.integers(0, 256, (9, width), np.uint8), RNG.integers(0, 5, 9)
            assert unfiltered(raw, kinds, step).tolist() == _plainly(raw.tolist(), kinds.tolist(), step)
            if width % step == 0:
                again = np.frombuffer(filtered(unfiltered(raw, kinds, step), kinds, step), np.uint8).reshape(9, -1)
                assert (again[:, 1:] == raw).all() and (again[:, 0] == kinds).all()


def test_kinds_of_pictures():
    assert decode(_file(3, 1, 8, 3, [bytes([0, 2, 1])], PLTE=bytes(range(9)))).tolist() == [[[0, 1, 2], [6, 7, 8], [3, 4, 5]]]
    assert decode(_file(2, 1, 8, 3, [bytes([0, 1])], PLTE=bytes(6), tRNS=b"\x07")).tolist() == [[[0, 0, 0, 7], [0, 0, 0, 255]]]
    assert decode(_file(5, 1, 1, 0, [bytes([0b10110000])]))[0, :, 0].tolist() == [255, 0, 255, 255, 0]
    assert decode(_file(3, 1, 4, 0, [bytes([0x1F, 0x80])]))[0, :, 0].tolist() == [17, 255, 136]
    assert decode(_file(1, 1, 16, 2, [bytes([1, 99, 2, 99, 3, 99])])).tolist() == [[[1, 2, 3]]]
    good = encode(_picture(4, 4, 3))
    for bad in (b"", b"GIF89a", good[:40], good[:-20], good[:50] + bytes([good[50] ^ 1]) + good[51:], _file(1, 1, 8, 0, [b"a"], interlaced=1), _file(1, 2, 8, 0, [b"a"]), _file(1, 1, 8, 5, [b"a"]), _file(1 << 20, 1 << 20, 8, 2, [b"a"]), _file(1, 1, 8, 3, [b"\5"], PLTE=bytes(3))):
        with pytest.raises(ValueError):
            decode(bad)


def test_painting():
    pixels = np.full((10, 12, 4), 200, np.uint8)
    rects = [{"x": 1.5, "y": 2.0, "w": 2.0, "h": 1.2}, {"x": -5.0, "y": 8.0, "w": 100.0, "h": 100.0}, {"x": 50.0, "y": 0.0, "w": 1.0, "h": 1.0}, {"x": 0.0, "y": 0.0, "w": 0.0, "h": 3.0}, {"x": None, "y": 0.0, "w": 1.0, "h": 3.0}]
    out = painted(pixels, rects)
    dark = np.zeros((10, 12), bool)
    dark[2:4, 1:4] = dark[8:, :] = True
    assert ((out[..., :3] == 0).all(axis=2) == dark).all() and (out[dark][:, 3] == 255).all() and (out[~dark] == 200).all() and (pixels == 200).all()


def test_brightness():
    pixels = np.zeros((20, 20, 3), np.uint8)
    pixels[:, 10:] = 30, 60, 90
    assert mean_brightness(pixels, 10, 0, 10, 10) == 60.0 and mean_brightness(pixels, 0, 0, 10, 10) == 0.0
    # points at 2, 6, 10, 14 of both sides: half of them in the bright half
    assert mean_brightness(pixels, 0, 0, 20, 20) == 30.0
    # a small rectangle has one point, one beyond the picture is dark
    assert mean_brightness(pixels, 12, 3, 1, 1) == 60.0 and mean_brightness(pixels, 100, 3, 9, 9) == 0.0
    assert mean_brightness(np.full((5, 5, 2), 9, np.uint8), 0, 0, 5, 5) == 9.0


def test_tables_of_pictures(spark, tmp_path):
    """From files to files; broken pictures are not passed on; pages without masks, nulls, clashing names, no rows."""
    (tmp_path / "in").mkdir()
    shots = {n: _picture(30, 40, 3) for n in ("a", "b")}
    for n, pixels in shots.items():
        (tmp_path / "in" / f"{n}.png").write_bytes(encode(pixels, (4, 1)))
    (tmp_path / "in" / "c.png").write_bytes(b"broken")
    (tmp_path / "in" / "d.txt").write_bytes(b"no picture")
    pictures = read_pictures(spark, str(tmp_path / "in")).withColumn("page", F.regexp_extract("path", "([a-z])\\.png", 1)).withColumn("_rects", F.lit("clash")).drop("path", "_rects")
    pictures = pictures.unionByName(spark.createDataFrame([(None, "n"), (bytearray(encode(shots["a"])), None)], "content binary, page string"))
    masks = spark.createDataFrame([("a", 2.0, 3.0, 5.0, 6.0), ("a", 30.0, 20.0, 50.0, 50.0), ("a", None, 1.0, 1.0, 1.0), ("z", 0.0, 0.0, 9.0, 9.0), (None, 0.0, 0.0, 99.0, 99.0)], "page string, x double, y double, w double, h double")
    out = {r.page: r.content for r in paint(pictures, masks, ["page"]).collect()}
    want = shots["a"].copy()
    want[3:9, 2:7] = want[20:, 30:] = 0
    assert (decode(bytes(out["a"])) == want).all() and (decode(bytes(out["b"])) == shots["b"]).all()
    assert out["c"] is None and out["n"] is None and (decode(bytes(out[None])) == shots["a"]).all()
    rects = masks.withColumn("ord", F.monotonically_increasing_id())
    seen = {(r.page, r.brightness) for r in brightness(paint(pictures, masks, ["page"]), rects, ["page"]).collect()}
    assert ("a", 0.0) in seen and ("a", None) in seen and ("z", None) in seen and len(seen) == 4
    assert paint(pictures.where("false"), masks, ["page"]).count() == 0 and brightness(pictures, rects.where("false"), ["page"]).count() == 0


def test_read_together(spark):
    """Files of all filters and sizes, broken ones among them, as each alone; bands and many rectangles change nothing."""
    shapes = [(30, 40, 3, (3, 4, 1)), (7, 40, 3, (4,)), (1, 40, 3, (2,)), (9, 11, 4, (3,)), (2300, 5, 3, (4, 3)), (30, 40, 3, (0,))]
    files = [None, b"broken", *(encode(_picture(h, w, c), kinds) for h, w, c, kinds in shapes), None]
    got = list(decode_all(files))
    assert [g is None for g in got] == [f in (None, b"broken") for f in files]
    assert all((g == decode(f)).all() for g, f in zip(got, files, strict=True) if g is not None)
    pixels = _picture(50, 60, 3)
    rects = [{"x": float(x), "y": y * 1.5, "w": 9.0 + x % 2, "h": 7.0} for x in range(-8, 60, 7) for y in range(-3, 40, 5)] + [{"x": 1.0, "y": None, "w": 3.0, "h": 3.0}]
    assert brightness_of(pixels, rects) == [None if r["y"] is None else mean_brightness(pixels, **r) for r in rects] and brightness_of(None, rects[:2]) == [None, None]
    pictures = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "page int, content binary")
    places = spark.createDataFrame([(i % 11, float(i), i * 2.0, i * 0.7, 6.0 + i % 3, 5.0) for i in range(60)], "page int, ord double, x double, y double, w double, h double")
    masks = places.where("ord % 3 = 0").drop("ord")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = brightness(pictures, places, ["page"]).withColumnRenamed("brightness", "before").join(brightness(paint(pictures, masks, ["page"]), places, ["page"]).withColumnRenamed("brightness", "after"), ["page", "ord"])
    assert rows(brightness_painted(pictures, masks, places, ["page"])) == rows(want) and len(rows(want)) == 60

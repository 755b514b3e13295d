"""Pictures: PNG files as arrays of pixels, rectangles painted over, brightness measured.

Pictures are read by Spark as binary files, one row each, and worked on in Arrow tasks, one at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from ..cluster import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type; bytes of pixels that a picture may have, larger ones are not read; distance of measured points.
CHANNELS, MOST_BYTES, STEP = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}, 1 << 28, 4
#: Scanlines whose filters are undone at once; bytes of the pictures that are read at once, or one picture.
BAND, TOGETHER = 1024, 1 << 22
#: Pictures that a task holds at once as files.
TURN = 32
RECTS = "array<struct<x: double, y: double, w: double, h: double>>"


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(name + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a broken part")
        yield name, body
        at += 12 + size


def unfiltered(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Scanlines (row x byte) with their filters undone; ``step`` is the bytes of a pixel."""
    if not np.isin(kinds, (0, 1, 2, 3, 4)).all():
        raise ValueError("an unknown filter")
    height, width = raw.shape
    columns = -(-width // step)
    if (kinds >= 3).any():
        above = np.zeros((1, width), np.uint8)
        bands = []
        for at in range(0, height, BAND):
            # the line above a band goes before it as one without a filter
            bands.append(_slanted(np.vstack([above, raw[at : at + BAND]]), np.append(0, kinds[at : at + BAND]), step)[1:])
            above = bands[-1][-1:]
        return np.vstack(bands)
    out = np.zeros((height, columns * step), np.uint8)
    out[:, :width] = raw
    left = np.flatnonzero(kinds == 1)
    if len(left):
        # pixel after pixel of all such lines; bytes wrap by themselves
        lines = np.ascontiguousarray(out[left].reshape(len(left), columns, step).transpose(1, 0, 2)).reshape(columns, -1)
        for before, now in zip(lines, lines[1:], strict=False):
            now += before
        out[left] = lines.reshape(columns, len(left), step).transpose(1, 0, 2).reshape(len(left), -1)
    for r in np.flatnonzero(kinds == 2).tolist():
        if r:
            out[r] += out[r - 1]
    return out[:, :width]


def _slanted(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """``unfiltered`` for all filters."""
    height, width = raw.shape
    columns = -(-width // step)
    # a pixel needs those to its left, above, and above left: all on one slanted line are done at once, and lie side by side
    # where each scanline stands one place further on than the one above; a scanline that needs none above it stands at the
    # start again. Before a scanline's start all is zero, and what comes after its end no pixel needs
    place = np.arange(height) - np.maximum.accumulate(np.where(kinds < 2, np.arange(height), 0))
    slant = np.zeros((columns + int(place.max()), height, step), np.uint8)
    line = np.zeros((height, columns * step), np.uint8)
    line[:, :width] = raw
    # a pixel is moved as one value
    whole = np.dtype((np.void, step))
    line, pixels = line.view(whole), slant.view(whole)[:, :, 0]
    own = np.argsort(place, kind="stable")
    own = np.split(own, np.cumsum(np.bincount(place))[:-1])
    for at, rows in enumerate(own):
        pixels[at : at + columns, rows] = line[rows].T
    slant = slant.reshape(len(slant), -1)
    is_left, is_up, is_mean, is_near = (np.repeat(kinds == k, step).astype(np.int16) for k in (1, 2, 3, 4))
    last, before = np.zeros((height + 1) * step, np.int16), np.zeros((height + 1) * step, np.int16)
    # how many slanted lines from each on are as the one before them
    alike = np.append((slant[1:] == slant[:-1]).all(axis=1), False)
    ends = np.flatnonzero(~alike)
    same = ends[np.searchsorted(ends, np.arange(len(slant)))] - np.arange(len(slant))
    at = 0
    while at < len(slant):
        now = slant[at].astype(np.int16)
        left, up, corner = last[step:], last[:-step], before[:-step]
        a, b = up - corner, left - corner
        c = np.abs(a + b)
        np.abs(a, out=a)
        np.abs(b, out=b)
        near = np.where(a <= np.minimum(b, c), left, np.where(b <= c, up, corner))
        now += is_near * near + is_mean * ((left + up) >> 1) + is_left * left + is_up * up
        now &= 255
        slant[at] = now
        # where three lines in a row come out alike, those that are given alike do so too
        more = int(same[at])
        if more and (now == left).all() and (last == before).all():
            slant[at + 1 : at + 1 + more] = now
            at += more
        last, before = before, last
        last[step:] = now
        at += 1
    for at, rows in enumerate(own):
        line[rows] = pixels[at : at + columns, rows].T
    return line.view(np.uint8)[:, :width]


def filtered(rows: np.ndarray, kinds: np.ndarray, step: int) -> bytes:
    """Scanlines (row x byte) under filters, each behind its filter's number."""
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0], line = kinds, out[:, 1:]
    line[:] = rows
    for kind in np.unique(kinds).tolist():
        r = np.flatnonzero(kinds == kind)
        # differences of bytes wrap by themselves
        if kind == 1:
            line[r, step:] = rows[r, step:] - rows[r, :-step]
        elif kind == 2:
            line[r[r > 0]] = rows[r[r > 0]] - rows[r[r > 0] - 1]
        elif kind:
            plain = rows[r].astype(np.int16)
            left, up, corner = np.zeros_like(plain), np.where(r[:, None] > 0, rows[r - 1], 0).astype(np.int16), np.zeros_like(plain)
            left[:, step:], corner[:, step:] = plain[:, :-step], up[:, :-step]
            if kind == 3:
                line[r] = (plain - ((left + up) >> 1)) & 255
            else:
                a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
                line[r] = (plain - np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))) & 255
    return out.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The pixels (row x column x channel) of a PNG file: grey, grey with alpha, colour, or colour with alpha, 8 bits each.

    Palettes become colours, finer shades the nearest below. Files that are broken, interlaced or beyond ``MOST_BYTES``
    raise a ValueError.
    """
    lines, kinds, step, finished = _opened(data)
    return finished(unfiltered(lines, kinds, step))


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray, int, Callable[[np.ndarray], np.ndarray]]:
    """A file's scanlines and their filters, the bytes of a pixel, and what makes pixels of the lines without filters."""
    if data[: len(SIGNATURE)] != SIGNATURE:
        raise ValueError("not a PNG file")
    parts: dict[bytes, bytes] = {}
    for name, body in _chunks(data):
        parts[name] = parts.get(name, b"") + body if name == b"IDAT" else body
    head = parts.get(b"IHDR", b"")
    if len(head) != 13 or b"IDAT" not in parts:
        raise ValueError("no picture")
    width, height, depth, kind, interlaced = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    if kind not in CHANNELS or depth not in (1, 2, 4, 8, 16) or interlaced or not width or not height:
        raise ValueError("a kind of picture that is not read")
    bits = depth * CHANNELS[kind]
    size = -(-width * bits // 8)
    if height * (size + 1) * (8 if depth < 8 else 1) > MOST_BYTES:
        raise ValueError("a picture that is too large")
    try:
        plain = zlib.decompressobj().decompress(parts[b"IDAT"], height * (size + 1))
    except zlib.error as e:
        raise ValueError("broken pixels") from e
    if len(plain) < height * (size + 1):
        raise ValueError("too few pixels")
    lines = np.frombuffer(plain, np.uint8).reshape(height, size + 1)

    def finished(rows: np.ndarray) -> np.ndarray:
        if depth == 16:
            rows = rows[:, ::2]
        elif depth < 8:
            rows = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth) @ (1 << np.arange(depth)[::-1])
            rows = rows if kind == 3 else rows * (255 // ((1 << depth) - 1))
        pixels = rows.reshape(height, width, CHANNELS[kind]).astype(np.uint8)
        return _coloured(pixels[..., 0], parts) if kind == 3 else pixels

    return lines[:, 1:], lines[:, 0], max(1, bits // 8), finished


def decode_all(files: list[bytes | None]) -> Iterator[np.ndarray | None]:
    """The pixels of each file, None for those that cannot be read. Small ones of one width are read together: one after
    another, with a line of zeros between them, which is what is above a picture's first line."""
    group: list[tuple] = []
    size = 0

    def read() -> Iterator[np.ndarray | None]:
        of: dict[tuple[int, int], list[int]] = {}
        for i, opened in enumerate(group):
            if opened is not None and np.isin(opened[1], (0, 1, 2, 3, 4)).all():
                of.setdefault((opened[0].shape[1], opened[2], bool((opened[1] >= 3).any())), []).append(i)
        plain: dict[int, np.ndarray] = {}
        for (width, step, hard), members in of.items():
            if not hard:
                plain |= {i: unfiltered(group[i][0], group[i][1], step) for i in members}
                continue
            empty = np.zeros((1, width), np.uint8)
            rows = unfiltered(np.vstack([x for i in members for x in (empty, group[i][0])]), np.concatenate([x for i in members for x in ([0], group[i][1])]), step)
            at = 0
            for i in members:
                plain[i], at = rows[at + 1 : at + 1 + len(group[i][0])], at + 1 + len(group[i][0])
        for i, opened in enumerate(group):
            try:
                yield opened[3](plain[i]) if i in plain else None
            except ValueError:
                yield None

    for data in files:
        try:
            opened = None if data is None else _opened(bytes(data))
        except ValueError:
            opened = None
        own = 0 if opened is None else opened[0].size
        if group and size + own > TOGETHER:
            yield from read()
            group, size = [], 0
        group.append(opened)
        size += own
    yield from read()


def _coloured(at: np.ndarray, parts: dict[bytes, bytes]) -> np.ndarray:
    palette = np.frombuffer(parts.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
    if not len(palette) or at.max() >= len(palette):
        raise ValueError("a colour that the palette lacks")
    if b"tRNS" not in parts:
        return palette[at]
    alpha = np.full(len(palette), 255, np.uint8)
    given = np.frombuffer(parts[b"tRNS"], np.uint8)[: len(palette)]
    alpha[: len(given)] = given
    return np.dstack([palette[at], alpha[at]])


def encode(pixels: np.ndarray, kinds: tuple[int, ...] = (2,), level: int = 6) -> bytes:
    """A PNG file of pixels (row x column x channel); rows take the filters of ``kinds`` in turn. Equal pixels give equal bytes.

    A file that is soon read again is written and read faster at ``level`` 1, and about twice as large."""
    height, width, channels = pixels.shape
    kind = {n: k for k, n in CHANNELS.items() if k != 3}[channels]
    rows = np.resize(np.array(kinds), height)
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, kind, 0, 0, 0])
    part = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
    body = zlib.compress(filtered(pixels.reshape(height, -1), rows, channels), level)
    return SIGNATURE + part(b"IHDR", head) + part(b"IDAT", body) + part(b"IEND", b"")


def painted(pixels: np.ndarray, rects: list[dict]) -> np.ndarray:
    """Pixels with rectangles in opaque black: every pixel that a rectangle touches."""
    out = pixels.copy()
    height, width, channels = out.shape
    for r in rects:
        if None in (r["x"], r["y"], r["w"], r["h"]) or r["w"] <= 0 or r["h"] <= 0:
            continue
        x0, y0 = max(0, int(np.floor(r["x"]))), max(0, int(np.floor(r["y"])))
        x1, y1 = min(width, int(np.ceil(r["x"] + r["w"]))), min(height, int(np.ceil(r["y"] + r["h"])))
        if x0 < x1 and y0 < y1:
            out[y0:y1, x0:x1] = 0
            if channels in (2, 4):
                out[y0:y1, x0:x1, -1] = 255
    return out


def mean_brightness(pixels: np.ndarray, x: float, y: float, w: float, h: float, step: int = STEP) -> float:
    """Mean of the colours at points on a grid within a rectangle, two pixels from its edge; beyond the picture it is dark."""
    half_up = lambda v: np.floor(v + 0.5).astype(np.int64)
    columns, rows = half_up(x + np.arange(2, max(w - 2, 3), step)), half_up(y + np.arange(2, max(h - 2, 3), step))
    inside = ((rows >= 0) & (rows < pixels.shape[0]))[:, None] & ((columns >= 0) & (columns < pixels.shape[1]))
    colours = pixels[..., :3] if pixels.shape[2] >= 3 else pixels[..., :1]
    seen = colours[np.clip(rows, 0, pixels.shape[0] - 1)[:, None], np.clip(columns, 0, pixels.shape[1] - 1)].mean(axis=2)
    return float(np.where(inside, seen, 0.0).mean())


def brightness_of(pixels: np.ndarray | None, rects: list[dict], step: int = STEP) -> list[float | None]:
    """``mean_brightness`` of each rectangle; those with as many points are measured at once. Null where the picture or a
    side is null."""
    out: list[float | None] = [None] * len(rects)
    known = [i for i, r in enumerate(rects) if pixels is not None and None not in (r["x"], r["y"], r["w"], r["h"])]
    of: dict[tuple[float, float], list[int]] = {}
    for i in known:
        of.setdefault((rects[i]["w"], rects[i]["h"]), []).append(i)
    for (w, h), members in of.items():
        if len(members) == 1:
            out[members[0]] = mean_brightness(pixels, rects[members[0]]["x"], rects[members[0]]["y"], w, h, step)
            continue
        across, down = np.arange(2, max(w - 2, 3), step), np.arange(2, max(h - 2, 3), step)
        for some in (members[k : k + max(1, (1 << 20) // (len(across) * len(down)))] for k in range(0, len(members), max(1, (1 << 20) // (len(across) * len(down))))):
            x, y = (np.floor(np.array([rects[i][c] for i in some])[:, None] + by + 0.5).astype(np.int64) for c, by in (("x", across), ("y", down)))
            inside = ((y >= 0) & (y < pixels.shape[0]))[:, :, None] & ((x >= 0) & (x < pixels.shape[1]))[:, None, :]
            colours = pixels[..., :3] if pixels.shape[2] >= 3 else pixels[..., :1]
            seen = colours[np.clip(y, 0, pixels.shape[0] - 1)[:, :, None], np.clip(x, 0, pixels.shape[1] - 1)[:, None, :]].mean(axis=3)
            for i, v in zip(some, np.where(inside, seen, 0.0).reshape(len(some), -1).mean(axis=1).tolist(), strict=True):
                out[i] = v
    return out


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the PNG files under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _with(rows: DataFrame, name: str, kind: DataType, made: Callable[[dict], object], drop: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``name`` made of each row, one at a time, without the columns of ``drop``."""
    ship(rows.sparkSession)
    others = [f for f in rows.schema.fields if f.name != name and f.name not in drop]
    schema = StructType([*others, StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held = row.to_pylist()[0]
                columns = [row.column(row.schema.get_field_index(f.name)) for f in others] + [pa.array([made(held)], out.field(name).type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return rows.mapInArrow(run, schema)


def _read(content: bytes | None) -> np.ndarray | None:
    try:
        return None if content is None else decode(bytes(content))
    except ValueError:
        return None


def _by_page(rows: DataFrame, keys: list[str], name: str, *columns: str) -> DataFrame:
    """Rows of a page as one array; a page's rows are bounded by what a screen holds."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias(name))


def paint(pictures: DataFrame, masks: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``pictures`` (``keys``, ``content``) with the rectangles (``x, y, w, h``) of their page painted black.

    Pictures without masks are written anew, unchanged in their pixels. Pictures that cannot be read become null: a
    picture that may show what is to be masked is never passed on. Null and empty rectangles paint nothing. Null keys
    match nothing. Other columns stay.
    """
    rects = _by_page(masks.select(*keys, *(F.col(c).cast("double").alias(c) for c in "xywh")), keys, "_rects", *"xywh")

    def made(row: dict) -> bytes | None:
        pixels = _read(row[content])
        return None if pixels is None else encode(painted(pixels, row["_rects"] or []))

    return _with(pictures.join(rects, keys, "left"), content, _parse_datatype_string("binary"), made, ("_rects",)).select(*pictures.columns)


def brightness(pictures: DataFrame, rects: DataFrame, keys: list[str], content: str = "content", step: int = STEP) -> DataFrame:
    """``rects`` (``keys``, ``ord``, ``x, y, w, h``) as ``keys, ord, brightness``: the mean colour of a grid of points in the
    picture of their page. Rectangles without a picture, of unreadable ones, or null ones have null; ``ord`` tells the
    rectangles of a page apart."""
    listed = _by_page(rects.select(*keys, F.col("ord").cast("long").alias("ord"), *(F.col(c).cast("double").alias(c) for c in "xywh")), keys, "_rects", "ord", *"xywh")

    def made(row: dict) -> list[dict]:
        return [{"ord": r["ord"], "brightness": v} for r, v in zip(row["_rects"], brightness_of(_read(row[content]), row["_rects"], step), strict=True)]

    rows = listed.join(pictures.select(*keys, content), keys, "left")
    found = _with(rows, "_seen", _parse_datatype_string("array<struct<ord: bigint, brightness: double>>"), made, ("_rects", content))
    return found.select(*keys, F.explode("_seen").alias("_s")).select(*keys, "_s.ord", "_s.brightness")


def brightness_painted(pictures: DataFrame, masks: DataFrame, rects: DataFrame, keys: list[str], content: str = "content", step: int = STEP) -> DataFrame:
    """``rects`` as ``keys, ord, before, after``: their ``brightness`` in ``pictures`` and in what ``paint`` makes of these.

    Each picture is read once, painted, written and read again as a file within one task.
    """
    numbers = lambda df: [F.col(c).cast("double").alias(c) for c in "xywh"]
    listed = _by_page(rects.select(*keys, F.col("ord").cast("long").alias("ord"), *numbers(rects)), keys, "_rects", "ord", *"xywh")
    painting = _by_page(masks.select(*keys, *numbers(masks)), keys, "_masks", *"xywh")
    rows = listed.join(pictures.select(*keys, F.col(content).alias("_content")), keys, "left").join(painting, keys, "left")
    ship(rows.sparkSession)
    kind = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL("ord long, before double, after double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        for batch in batches:
            for part in (batch.slice(i, TURN) for i in range(0, batch.num_rows, TURN)):
                column = lambda name: part.column(part.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
                places, painted_over = column("_rects"), column("_masks")
                before, files = [], []
                for pixels, at, over in zip(decode_all(column("_content")), places, painted_over, strict=True):
                    before += brightness_of(pixels, at, step)
                    files.append(None if pixels is None else encode(painted(pixels, over or []), level=1))
                after = [v for pixels, at in zip(decode_all(files), places, strict=True) for v in brightness_of(pixels, at, step)]
                owner = pa.array([i for i, at in enumerate(places) for _ in at], pa.int64())
                made = [*(part.column(part.schema.get_field_index(k)).take(owner) for k in keys), pa.array([r["ord"] for at in places for r in at], pa.int64()), pa.array(before, pa.float64()), pa.array(after, pa.float64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, out, strict=True)], schema=out)

    return rows.mapInArrow(run, kind)

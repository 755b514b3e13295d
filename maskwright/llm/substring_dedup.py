"""Removal of word windows that repeat anywhere in the corpus, behind a count-min prefilter.

Texts are dealt into blocks of bounded size. Pass one: each block sends, to every range of window hashes, the cells
that its windows touch (a sparse count-min sketch of the block); the sketches of a range are merged, and each block
gets back those of its cells that are estimated to hold more than one window. Pass two: each block sends the exact
keys of windows in such cells, once each; keys that a range holds more than once come back. The count-min estimate
is never too low, so no repeated window is lost, and most windows never leave their block as a key. Every group in
Python is one block or one range, whose sizes follow from parameters and not from how often a window repeats: a
block sends a cell or key once, however many copies it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from .arrow_rows import flat_bytes, frugal, slices
from .words import Words, mix

#: Words in a window.
WINDOW = 35
#: Text bytes in a block, and text bytes whose windows fall into one range, about.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: Bits of a cell within its range; bits of a row of the merged sketch, which has two rows of saturating counters.
CELL_BITS, SKETCH_BITS, ENOUGH = 28, 24, 100

_PACKED = "range long, block long, packed binary"
_PACKED_ARROW = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("packed", pa.binary())])


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences, byte planes apart, so that the shuffle's compression works."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unpack(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(packed, np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _parts(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "text")


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of ``ranges`` equal ranges holds each key; ascending keys give ascending ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _cells(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range and cell of each key in one integer."""
    return (range_of(keys, ranges) << np.uint64(CELL_BITS)) | (mix(keys) >> np.uint64(64 - CELL_BITS))


def by_range(block: int, codes: np.ndarray, ranges: np.ndarray, packed: Callable[[int, int], bytes]) -> pa.Table:
    """One row for each range, from ``codes`` that lie in ascending order of range."""
    found, first = np.unique(ranges, return_index=True)
    ends = np.append(first[1:], len(codes))[: len(first)]
    rows = [packed(a, b) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    return pa.Table.from_arrays([pa.array(found.astype(np.int64)), pa.array(np.full(len(found), block)), pa.array(rows, pa.binary())], schema=_PACKED_ARROW)


def _block_keys(batches: list[pa.RecordBatch], window: int) -> np.ndarray:
    found = [np.zeros(0, np.uint64)]
    for part in _parts(batches):
        words = Words(*flat_bytes(part, "text"))
        found.append(words.windows(window)[words.whole(window)])
    return np.concatenate(found)


def _estimate(rows: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """Merges the sparse sketches of one range; for each, its cells whose estimate is over one."""
    size = np.uint32((1 << SKETCH_BITS) - 1)
    where = lambda c: (c & size, (c * np.uint32(2654435769)) >> np.uint32(32 - SKETCH_BITS))
    counters = np.zeros((2, 1 << SKETCH_BITS), np.uint8)
    for _, code in rows:
        cells, several = code >> np.uint32(1), (code & np.uint32(1)).astype(np.uint8)
        for row, at in zip(counters, where(cells), strict=True):
            np.add.at(row, at, np.uint8(1) + several)
            row[at] = np.minimum(row[at], ENOUGH)
    out = []
    for _, code in rows:
        cells = code >> np.uint32(1)
        low = np.minimum(*(row[at] for row, at in zip(counters, where(cells), strict=True)))
        out.append(cells[low > 1])
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_text``.

    Words are runs of bytes other than ASCII white space. A word goes if a window of ``window`` words that covers it
    has the same words as a window that starts anywhere else, in the input. The rest is joined by one space. Null,
    empty and shorter texts keep their words (null and empty ones have none); an empty table gives an empty result;
    other columns are ignored. Windows are told apart by 96 bits of hash.

    At far larger inputs raise ``block_bytes`` and ``range_bytes`` so that blocks x ranges stays below the windows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = 4 * spark.sparkContext.defaultParallelism
    n_blocks, n_ranges = max(least, -(-total // block_bytes)), max(least, -(-total // range_bytes))
    # by place in the scan as well, so that repeated rows are dealt to many blocks; all steps read the same shuffle
    place = F.monotonically_increasing_id()
    blocks = rows.select(F.pmod(F.xxhash64("doc_id", "text", place), F.lit(n_blocks)).alias("block"), "doc_id", "text")

    def touch(key: tuple, table: pa.Table) -> pa.Table:
        cells, times = np.unique(_cells(_block_keys(table.to_batches(), window), n_ranges), return_counts=True)
        codes = ((cells & np.uint64((1 << CELL_BITS) - 1)) << np.uint64(1) | (times > 1)).astype(np.uint32)
        return by_range(key[0].as_py(), codes, cells >> np.uint64(CELL_BITS), lambda a, b: pack(codes[a:b]))

    def estimate(table: pa.Table) -> pa.Table:
        sent = [(b, unpack(p, np.uint32)) for b, p in zip(table["block"].to_pylist(), table["packed"].to_pylist(), strict=True)]
        back = [(b, pack(c)) for (b, _), c in zip(sent, _estimate(sent), strict=True) if len(c)]
        return answer(table["range"][0].as_py(), back)

    def exact_keys(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        allowed = [np.zeros(0, np.uint64)]
        for r, p in zip(right["range"].to_pylist(), right["packed"].to_pylist(), strict=True):
            allowed.append(unpack(p, np.uint32).astype(np.uint64) | np.uint64(r << CELL_BITS))
        allowed = np.sort(np.concatenate(allowed))
        keys, more = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for part in _parts(left.to_batches()):
            words = Words(*flat_bytes(part, "text"))
            whole = words.whole(window)
            found = words.windows(window)[whole]
            held = np.flatnonzero(_holds(allowed, _cells(found, n_ranges)))
            keys.append(found[held])
            more.append(words.windows(window, 1)[whole[held]].astype(np.uint32))
        keys, more = np.concatenate(keys), np.concatenate(more)
        order = np.lexsort((more, keys))
        keys, more = keys[order], more[order]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (more[1:] != more[:-1]))[: len(keys)])
        several = (np.diff(np.append(first, len(keys))) > 1).astype(np.uint8)
        keys, more = keys[first], more[first]
        both = lambda a, b: pack(keys[a:b]) + more[a:b].tobytes() + several[a:b].tobytes()
        return by_range(key[0].as_py(), keys, range_of(keys, n_ranges), both)

    def repeated(table: pa.Table) -> pa.Table:
        keys, more, times, owner = [], [], [], []
        names = table["block"].to_pylist()
        for i, p in enumerate(table["packed"].to_pylist()):
            n = len(p) // 13
            keys.append(unpack(p[: 8 * n], np.uint64))
            more.append(np.frombuffer(p, np.uint32, n, 8 * n))
            times.append(np.frombuffer(p, np.uint8, n, 12 * n).astype(np.int64) + 1)
            owner.append(np.full(n, i))
        keys, more, times, owner = (np.concatenate(x) for x in (keys, more, times, owner))
        order = np.lexsort((more, keys))
        keys, more, times, owner = keys[order], more[order], times[order], owner[order]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])))
        total = np.repeat(np.add.reduceat(times, first), np.diff(np.append(first, len(keys))))
        keys, more, owner = keys[total > 1], more[total > 1], owner[total > 1]
        order = np.argsort(owner, kind="stable")
        keys, more, cuts = keys[order], more[order], np.cumsum(np.bincount(owner, minlength=len(names)))[:-1]
        parts = zip(names, np.split(keys, cuts), np.split(more, cuts), strict=True)
        return answer(table["range"][0].as_py(), [(b, pack(k) + m.tobytes()) for b, k, m in parts if len(k)])

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        gone, more = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for p in right["packed"].to_pylist():
            n = len(p) // 12
            gone.append(unpack(p[: 8 * n], np.uint64))
            more.append(np.frombuffer(p, np.uint32, n, 8 * n))
        gone, more = np.concatenate(gone), np.concatenate(more)
        order = np.lexsort((more, gone))
        gone, more = gone[order], more[order]
        made = []
        for part in _parts(left.to_batches()):
            flat, offsets = flat_bytes(part, "text")
            words = Words(flat, offsets)
            whole = words.whole(window)
            own = words.windows(window)[whole]
            held = np.flatnonzero(_holds(gone, own))
            # both hashes of a window must be among those that repeat
            second, first, last = words.windows(window, 1)[whole[held]].astype(np.uint32), np.searchsorted(gone, own[held]), np.searchsorted(gone, own[held], "right")
            same = more[first] == second if len(held) else np.zeros(0, bool)
            for i in np.flatnonzero(~same & (last - first > 1)):
                same[i] = second[i] in more[first[i] : last[i]]
            starts = whole[held[same]]
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + window, -1)
            keep = np.cumsum(steps[:-1]) == 0
            n_words = np.bincount(words.text, minlength=part.num_rows)
            n_removed = np.bincount(words.text, ~keep, minlength=part.num_rows).astype(np.int64)
            ends, kept = np.cumsum(n_words), []
            data = flat.tobytes()
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                said = data[a:b].split()
                kept.append(b" ".join(compress(said, keep[ends[i] - n_words[i] : ends[i]].tolist()) if n_removed[i] else said))
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            made.append(pa.Table.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(n_words), pa.array(n_removed), kept], names=["doc_id", "n_words", "n_removed", "kept_text"]))
        return pa.concat_tables(made) if made else pa.table({n: pa.array([], t) for n, t in zip(["doc_id", "n_words", "n_removed", "kept_text"], [left.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string()], strict=True)})

    by_block = blocks.groupBy("block")
    touched = by_block.applyInArrow(frugal(touch), _PACKED).groupBy("range").applyInArrow(frugal(estimate), _PACKED)
    keys = by_block.cogroup(touched.groupBy("block")).applyInArrow(frugal(exact_keys), _PACKED)
    answers = keys.groupBy("range").applyInArrow(frugal(repeated), _PACKED)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(frugal(remove), f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def answer(at: int, back: list[tuple[int, bytes]]) -> pa.Table:
    columns = [pa.array([at] * len(back), pa.int64()), pa.array([b for b, _ in back], pa.int64()), pa.array([p for _, p in back], pa.binary())]
    return pa.Table.from_arrays(columns, schema=_PACKED_ARROW)


def _holds(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values

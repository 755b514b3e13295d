"""Matches that reach over the units of a block: patterns, measures, phrases.

The units of a whole Arrow batch lie one after another in one text, with a mark between blocks that no pattern and no
phrase can cross. Each pattern scans that text once; matches become unit numbers by binary search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .. import vocab as V
from ..cluster import ship, wide_rows
from ..vocab import Rules

_PY = lambda p: re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", p)
# Words side by side make runs of thousands of letters, in which a search that may start anywhere takes quadratic time.
# Local parts can only start where letters and digits do, as what starts within them starts there as well.
HEAD, TAIL, DIGIT_RUN = re.compile(f"(?<![a-z0-9]){V.EMAIL_HEAD}"), re.compile(V.EMAIL_TAIL), re.compile(V.DIGIT_RUN)
ALNUM = set("abcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | set("._%+-")
METRIC = re.compile(V.METRIC_BEFORE + V.METRIC + r"(?![^\W_])")
DROP = re.compile(f"[{_PY(V.PHRASE_DROP)}]+")
WIDTH, WIDE_RUN = str.maketrans(V.WIDE, V.NARROW), re.compile(f"[{V.WIDE}]+")
#: What ``DIGIT_RUN`` holds between its first sign and its last.
RUN_CHAR = V.DIGIT_RUN[V.DIGIT_RUN.index("[0-9]") + 5 : V.DIGIT_RUN.index("*")]
#: Reasons of line patterns by number.
REASONS = [None, "email-frag", "email", "digit-run"]
#: Stands between blocks; no pattern, phrase or measure holds it.
MARK = "\0"
#: Bytes of units that are joined at once; a longer block is a slice of its own.
SLICE_BYTES = 1 << 20
#: Phrases that are looked for one by one; more of them form an automaton.
FEW = 512
FLAGS = {"line_reason": "array<string>", "unit_metric": "array<boolean>", "user_kept": "array<boolean>", "label_kept": "array<boolean>"}


def fold(text: str) -> str:
    return (text if text.isascii() else WIDE_RUN.sub(lambda m: m.group().translate(WIDTH), text)).lower()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _class(chars: str) -> np.ndarray:
    """Which code points up to U+FFFF are among ``chars``; the last stands for all beyond."""
    found = np.zeros(1 << 16, bool)
    found[_codes(chars)] = True
    return found


_ALL = "".join(map(chr, range((1 << 16) - 1)))
DROPPED, IS_ALNUM, IS_JOINT = _class("".join(DROP.findall(_ALL))), _class("".join(ALNUM)), _class("._%+-")
IS_DIGIT, IN_RUN = _class("0123456789"), _class("".join(re.findall(RUN_CHAR, _ALL)))
#: Bytes that part words.
GAPS = np.isin(np.arange(256), np.frombuffer(b" \t\r\x0b\f", np.uint8))


class Units:
    """Units as one ``text`` with how many characters each has (``sizes``), and their forms, each made once."""

    def __init__(self, text: str, sizes: np.ndarray):
        self.text, self.sizes = text, sizes

    @classmethod
    def of(cls, units: list[str]) -> Units:
        return cls("".join(units), np.fromiter(map(len, units), np.int64, len(units)))

    @classmethod
    def of_array(cls, units: pa.Array) -> Units:
        """Null units are empty."""
        at, held = _bytes_of(units)
        text = held.tobytes().decode()
        if len(text) == len(held):
            return cls(text, np.diff(at))
        return cls(text, np.diff(np.append(0, np.cumsum((held & 0xC0) != 0x80))[at]))

    @cached_property
    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters of the folded units, and how many each has."""
        text, sizes = fold(self.text), self.sizes
        # a sigma's small form depends on what stands beside it, and some small letters are two characters
        if len(text) != len(self.text) or "Σ" in self.text:
            ends = np.cumsum(sizes)
            units = [fold(self.text[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            text, sizes = "".join(units), np.fromiter(map(len, units), np.int64, len(units))
        return _codes(text), sizes

    @cached_property
    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """The same without white space and punctuation."""
        if "Σ" in self.text:  # what stands beside a sigma is dropped first
            ends = np.cumsum(self.sizes)
            bare = Units.of([DROP.sub("", self.text[a:b]) for a, b in zip((ends - self.sizes).tolist(), ends.tolist(), strict=True)])
            return bare.folded
        codes, sizes = self.folded
        stays = ~DROPPED[np.minimum(codes, 0xFFFF)]
        upto, ends = np.append(0, np.cumsum(stays)), np.cumsum(sizes)
        return codes[stays], upto[ends] - upto[ends - sizes]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins (and the last ends) in the bytes of all, and these. Null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, at, held = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at - at[0], np.frombuffer(held or b"", np.uint8)[at[0] : at[-1]]


def words_of(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all lines, one after another, and where each line's begin (and the last's end)."""
    at, held = _bytes_of(lines)
    gap = np.append(GAPS[held], True)
    edge = np.zeros(len(held) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(~gap[:-1] & (np.append(True, gap[:-2]) | edge[:-1])) if len(held) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~gap[:-1] & (gap[1:] | edge[1:])) + 1
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(held[~gap[:-1]].tobytes()))
    return words, np.searchsorted(starts, at)


def phrase_forms(units: list[str]) -> list[str]:
    """Units folded, without white space and punctuation."""
    codes, sizes = Units.of(units).phrases
    text, ends = np.where(codes == 0, 32, codes).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"), np.cumsum(sizes)
    return [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def offsets_of_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """Where the units of each block begin in those of all (and the last end), and the column of them."""
    column = batch.column(batch.schema.get_field_index("units")).cast(pa.large_list(pa.string()))
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.append(0, np.cumsum(sizes)), column


def block_breaks(offsets: np.ndarray) -> np.ndarray:
    """1 for each unit that begins a block."""
    breaks = np.zeros(offsets[-1] + 1, np.int64)
    breaks[offsets] = 1
    return breaks[:-1]


def slices_of(batch: pa.RecordBatch, limit: int = SLICE_BYTES, column: str = "units") -> Iterator[pa.RecordBatch]:
    """``batch`` in order, cut between blocks where the bytes of their units (or of a ``column`` of texts) would exceed ``limit``."""
    held = batch.column(batch.schema.get_field_index(column))
    length = lambda texts: pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if column == "units":
        held = held.cast(pa.large_list(pa.string()))
        count = pc.list_value_length(held).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.append(0, np.cumsum(length(held.flatten())))[np.cumsum(count)]
    else:
        upto = np.cumsum(length(held))
    start = 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def per_unit(values: np.ndarray | pa.Array, offsets: np.ndarray, null: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values of units as one list for each block; null blocks have a null list."""
    at = pa.array(offsets, pa.int32(), mask=np.append(null, False))
    return pa.ListArray.from_arrays(at, values if isinstance(values, pa.Array) else pa.array(values, kind.value_type)).cast(kind)


class Joined:
    """Units (texts, or the characters of all and how many each has) one after another, with a mark before each that
    ``breaks`` names, and, where there are ``gaps``, white space before the others."""

    def __init__(self, parts: list[str] | tuple[np.ndarray, np.ndarray], breaks: np.ndarray, gaps: bool = False):
        codes, self.sizes = (_codes("".join(parts)), Units.of(parts).sizes) if isinstance(parts, list) else parts
        marked = np.ones(len(breaks), bool) if gaps else breaks.astype(bool)
        self.starts = np.cumsum(self.sizes + marked) - self.sizes
        at = self.starts[marked] - 1
        self.codes, own = np.zeros(len(codes) + len(at), np.uint32), np.ones(len(codes) + len(at), bool)
        own[at] = False
        self.codes[own] = np.where(codes == 0, 32, codes)
        self.codes[at] = np.where(breaks[marked], 0, 32)
        self.text = self.codes.tobytes().decode("utf-32-le", "surrogatepass")

    def among(self, chars: np.ndarray) -> np.ndarray:
        """Which characters are of a class."""
        return chars[np.minimum(self.codes, 0xFFFF)]

    def block_starts(self, offsets: np.ndarray) -> np.ndarray:
        """Where each block's text begins; a block without units begins where the next one does."""
        return np.append(self.starts, len(self.text) + 1)[offsets[:-1]]

    def covered(self, spans: np.ndarray) -> np.ndarray:
        """How many characters of each unit the ``spans`` (rows of start and end) cover; overlaps count once."""
        depth = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(depth, spans[:, 0], 1)
        np.add.at(depth, spans[:, 1], -1)
        upto = np.append(0, np.cumsum(np.cumsum(depth)[:-1] > 0))
        return upto[self.starts + self.sizes] - upto[self.starts]


def _spans(found: Iterator[re.Match]) -> np.ndarray:
    return np.array([m.span() for m in found], np.int64).reshape(-1, 2)


def _emails(text: str) -> np.ndarray:
    """Whole addresses: from each sign with a domain behind it back to where its local part starts."""
    found, last = [], 0
    for m in TAIL.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        while start < m.start() and text[start] not in ALNUM:
            start += 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return np.array(found, np.int64).reshape(-1, 2)


def _heads(joined: Joined) -> np.ndarray:
    """What ``HEAD`` finds: it is tried only where letters or digits stand on both sides of two joints in a row."""
    alnum = joined.among(IS_ALNUM)
    joints = np.flatnonzero(joined.among(IS_JOINT)[1:-1] & alnum[:-2] & alnum[2:]) + 1
    others = np.flatnonzero(~alnum)
    nth = np.searchsorted(others, joints)
    first = np.flatnonzero(np.diff(nth) == 1)  # nothing but letters and digits up to the next joint
    found, last = [], 0
    for start in np.append(-1, others)[nth[first]] + 1:
        if start >= last and (m := HEAD.match(joined.text, start)):
            found.append(m.span())
            last = m.end()
    return np.array(found, np.int64).reshape(-1, 2)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True start and end."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return change[::2], change[1::2]


def _digit_runs(joined: Joined) -> np.ndarray:
    """What ``DIGIT_RUN`` finds: it is tried only in runs of its characters with two digits, one match in each."""
    starts, ends = _runs(joined.among(IN_RUN))
    upto = np.append(0, np.cumsum(joined.among(IS_DIGIT)))
    many = upto[ends] - upto[starts] > 1
    found = (DIGIT_RUN.search(joined.text, max(a - 1, 0), b + 1) for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True))
    return _spans(m for m in found if m)


def _metrics(joined: Joined) -> np.ndarray:
    """What ``METRIC`` finds: it is tried only at runs of digits and at signs before them. Matches never overlap, as none
    starts behind a character of another."""
    text, found = joined.text, []
    for a in _runs(joined.among(IS_DIGIT))[0].tolist():
        m = METRIC.match(text, a) or (METRIC.match(text, a - 1) if a else None)
        if m:
            found.append(m.span())
    return np.array(found, np.int64).reshape(-1, 2)


def _reasons(joined: Joined) -> np.ndarray:
    """The number in ``REASONS`` of the last pattern that covers a part of each unit."""
    out = np.zeros(len(joined.sizes), np.int8)
    # in the order of LINE_PATTERNS
    for reason, found in ((1, _spans(TAIL.finditer(joined.text))), (1, _heads(joined)), (2, _emails(joined.text)), (3, _digit_runs(joined))):
        if len(found):
            out[joined.covered(found) > 0] = reason
    return out


def _measured(joined: Joined) -> np.ndarray:
    return (joined.covered(_metrics(joined)) == joined.sizes) & (joined.sizes > 0)


def line_reasons(units: list[str], breaks: np.ndarray) -> np.ndarray:
    """The reason of the last pattern that covers a part of each unit, or None."""
    return np.array(REASONS, object)[_reasons(Joined(Units.of(units).folded, breaks))]


def metric_units(units: list[str], breaks: np.ndarray) -> np.ndarray:
    """Units of which measures cover every character; ``breaks`` part visual lines."""
    return _measured(Joined(Units.of(units).folded, breaks))


def one_by_one(text: str, phrases: list[str]) -> np.ndarray:
    """Rows of start and end of all occurrences, phrase by phrase."""
    found: list[tuple[int, int]] = []
    for phrase in phrases:
        at = text.find(phrase)
        while at >= 0:
            found.append((at, at + len(phrase)))
            at = text.find(phrase, at + 1)
    return np.array(found, np.int64).reshape(-1, 2)


def _held(joined: Joined, phrases: list[str], full: bool, automaton=None) -> np.ndarray:
    held = joined.covered(one_by_one(joined.text, phrases) if automaton is None else automaton.spans(joined.text))
    return (held == joined.sizes) & (held > 0) if full else held > 0


def protected(units: list[str], phrases: list[str], full: bool, breaks: np.ndarray, automaton=None) -> np.ndarray:
    """Units that phrases cover, in part or (``full``) wholly; occurrences may overlap. ``automaton`` of the same phrases
    finds them all at once."""
    if not phrases:
        return np.zeros(len(units), bool)
    return _held(Joined(Units.of(units).phrases, breaks), phrases, full, automaton)


def _phrases(terms: tuple[str, ...]) -> list[str]:
    return sorted({p for p in (fold(DROP.sub("", t)) for t in terms) if p and MARK not in p})


class _Flags:
    """What finds ``flags`` by ``rules``; phrases beyond ``FEW`` are shared as an automaton."""

    def __init__(self, spark: SparkSession, rules: Rules, names: tuple[str, ...]):
        from .phrase_search import Automaton

        self.names, self.phrases = names, {"user_kept": _phrases(rules.terms), "label_kept": _phrases(rules.labels)}
        self.shared = {n: spark.sparkContext.broadcast(Automaton(p)) for n, p in self.phrases.items() if n in names and len(p) > FEW}

    def of(self, units: Units, breaks: np.ndarray, lines: np.ndarray, gaps: bool = False) -> dict[str, pa.Array]:
        """Values of each flag for all units. ``breaks`` begin blocks, ``lines`` visual lines."""
        out, folded, phrases = {}, None, None
        for name in self.names:
            if name in self.phrases:
                wanted, shared = self.phrases[name], self.shared.get(name)
                phrases = phrases or (wanted and Joined(units.phrases, breaks))
                out[name] = pa.array(_held(phrases, wanted, name == "label_kept", shared and shared.value) if wanted else np.zeros(len(breaks), bool))
                continue
            folded = folded or Joined(units.folded, breaks, gaps)
            if name == "line_reason":
                out[name] = pa.array(REASONS, pa.string()).take(pa.array(_reasons(folded)))
            else:
                out[name] = pa.array(_measured(folded if lines is breaks else Joined(units.folded, lines, gaps)))
        return out


def with_spans(blocks: DataFrame, rules: Rules = Rules(), flags: tuple[str, ...] = tuple(FLAGS)) -> DataFrame:
    """``blocks`` (with ``units array<string>``) with one value for each unit in each of ``flags``.

    Where ``blocks`` has ``visual array<int>``, measures do not reach over units of different visual lines. Null units
    are empty; a null block has null flags. Columns named like a flag are replaced.
    """
    ship(blocks.sparkSession)
    wide_rows(blocks.sparkSession)
    found = _Flags(blocks.sparkSession, rules, flags)
    kept = [f for f in blocks.schema.fields if f.name not in flags]
    schema = StructType([*kept, *(StructField(n, _parse_datatype_string(FLAGS[n])) for n in flags)])
    has_lines = "visual" in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in (part for whole in batches for part in slices_of(whole)):
            offsets, column = offsets_of_batch(batch)
            lines = breaks = block_breaks(offsets)
            if has_lines:
                number = batch.column(batch.schema.get_field_index("visual")).flatten().to_numpy(zero_copy_only=False)
                lines = breaks | np.append(1, number[1:] != number[:-1])[: len(breaks)]
            made = found.of(Units.of_array(column.flatten()), breaks, lines)
            null = column.is_null().to_numpy(zero_copy_only=False)
            columns = [batch.column(batch.schema.get_field_index(f.name)).cast(out.field(f.name).type) for f in kept]
            columns += [per_unit(made[name], offsets, null, out.field(name).type) for name in flags]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return blocks.select(*(f.name for f in kept)).mapInArrow(run, schema)


def spanned_words(lines: DataFrame, rules: Rules = Rules(), flags: tuple[str, ...] = tuple(FLAGS), gaps: bool = False) -> DataFrame:
    """One row for each word of ``lines`` (with ``line``): its other columns, ``unit_idx, text`` and ``flags``.

    With ``gaps`` white space stands between words and counts in ``unit_idx``, as in ``spaced_blocks``; without, words
    stand side by side, as in ``word_blocks``. The rows are those of ``spread_units(with_spans(..))`` over these blocks;
    a line's come one after another in order.
    """
    ship(lines.sparkSession)
    wide_rows(lines.sparkSession)
    found = _Flags(lines.sparkSession, rules, flags)
    others = [f for f in lines.schema.fields if f.name not in ("line", *flags)]
    value = {n: _parse_datatype_string(FLAGS[n]).elementType for n in flags}
    schema = StructType([*others, *StructType.fromDDL("unit_idx int, text string").fields, *(StructField(n, value[n]) for n in flags)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in (part for whole in batches for part in slices_of(whole, column="line")):
            words, offsets = words_of(batch.column(batch.schema.get_field_index("line")))
            breaks, counts = block_breaks(offsets), np.diff(offsets)
            of_line = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            nth = (np.arange(len(words)) - np.repeat(offsets[:-1], counts)) * (2 if gaps else 1)
            made = found.of(Units.of_array(words), breaks, breaks, gaps)
            columns = [*(batch.column(batch.schema.get_field_index(f.name)).take(of_line) for f in others), pa.array(nth), words, *(made[n] for n in flags)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return lines.select(*(f.name for f in others), "line").mapInArrow(run, schema)


def same_block(table: pa.Table, keys: list[str]) -> np.ndarray:
    """For each row but the first, whether it has the ``keys`` of the row before; nulls are alike."""
    n = table.num_rows
    same = np.ones(max(n - 1, 0), bool)
    for k in keys if n else ():
        column = table.column(k).combine_chunks()
        before, after = column.slice(0, n - 1), column.slice(1)
        equal = pc.or_kleene(pc.equal(before, after), pc.and_(before.is_null(), after.is_null())) if not pa.types.is_nested(column.type) else pa.array([a == b for a, b in zip(before.to_pylist(), after.to_pylist(), strict=True)], pa.bool_())
        same &= equal.fill_null(False).to_numpy(zero_copy_only=False)
    return same


def _whole_blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come block by block as tables of whole blocks, and where each block begins (and the last ends)."""
    held: list[pa.RecordBatch] = []  # the last block so far, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*(h.slice(h.num_rows - 1) for h in held[-1:]), batch])
        starts = np.flatnonzero(~same_block(table, keys)) + 1 - len(held[-1:])
        if len(starts):
            last = int(starts[-1])
            sizes = sum(h.num_rows for h in held)
            yield pa.Table.from_batches([*held, batch.slice(0, last)]), np.append(0, starts + sizes)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held), np.array([0, sum(h.num_rows for h in held)])


def on_one_line(boxes: pa.ChunkedArray) -> np.ndarray:
    """``geometry.on_one_line`` of each box but the first and the one before it; sides that are null are left out, and NaN
    is beyond all numbers, as in Spark."""
    y0, y1 = (pc.struct_field(boxes, side).cast(pa.float64()).fill_null(beyond).to_numpy() for side, beyond in (("y0", -np.inf), ("y1", np.inf)))
    with np.errstate(invalid="ignore"):
        return ~(np.fmin(y1[1:], y1[:-1]) - np.maximum(y0[1:], y0[:-1]) <= 0)


def spanned_units(units: DataFrame, keys: list[str], rules: Rules = Rules(), flags: tuple[str, ...] = tuple(FLAGS), idx: str = "unit_idx") -> DataFrame:
    """``units`` (``keys, text``, in a block by ``idx``) with ``flags``, all other columns as they are.

    The flags are those of ``with_spans(blocks_of(units, keys))``: where there is ``bbox``, measures do not reach over
    units of different visual lines. Rows are sorted within their block and never gathered to lists; a task holds a
    block and a batch of rows at a time.
    """
    ship(units.sparkSession)
    has_lines = "bbox" in units.columns
    found = _Flags(units.sparkSession, rules, flags)
    others = [f for f in units.schema.fields if f.name not in flags]
    schema = StructType([*others, *(StructField(n, _parse_datatype_string(FLAGS[n]).elementType) for n in flags)])
    names = [f.name for f in others]
    rows = units.select(*names).repartition(*keys).sortWithinPartitions(*keys, idx)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for table, offsets in _whole_blocks(batches, keys):
            bytes_ = np.append(0, np.cumsum(pc.binary_length(table.column("text")).fill_null(0).to_numpy().astype(np.int64)))[offsets]
            start = 0
            while start < len(offsets) - 1:
                end = max(start + 1, int(np.searchsorted(bytes_, bytes_[start] + SLICE_BYTES, "right")) - 1)
                own = offsets[start : end + 1] - offsets[start]
                part = table.slice(offsets[start], own[-1]).combine_chunks()
                lines = breaks = block_breaks(own)
                at = part.column(idx).to_numpy()
                if ((at[1:] < at[:-1]) & (breaks[1:] == 0)).any():
                    raise ValueError("units of a block must come in order")
                if has_lines:
                    lines = breaks | np.append(1, ~on_one_line(part.column("bbox")))
                text = part.column("text").combine_chunks()
                made = found.of(Units.of_array(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)), breaks, lines)
                columns = [*(part.column(n) for n in names), *(made[n] for n in flags)]
                yield from pa.table([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out).to_batches()
                start = end

    return rows.mapInArrow(run, schema)


def spread_units(spanned: DataFrame, along: tuple[str, ...] = ()) -> DataFrame:
    """One row per unit: the block's other columns, ``unit_idx, text``, the flags that there are, ``token`` of
    ``tokens``, and each of ``along`` (arrays with one value for each unit)."""
    names = [*(c for c in FLAGS if c in spanned.columns), *along]
    # a block without tokens keeps its units, and tokens beyond the units make no rows
    own = lambda: F.slice(F.coalesce("tokens", F.array().cast(spanned.schema["tokens"].dataType)), F.lit(1), F.size("units"))
    tokens = [own().alias("token")] if "tokens" in spanned.columns else []
    others = [c for c in spanned.columns if c not in ("units", "tokens", "visual", *names)]
    zipped = F.posexplode(F.arrays_zip(F.col("units").alias("text"), *tokens, *names)).alias("unit_idx", "u")
    return spanned.select(*others, zipped).select(*others, "unit_idx", "u.*")

"""Searches for many phrases at once, in time linear in the text.

The phrases form an automaton after Aho and Corasick in flat arrays. A text is cut into lanes that all move one character
at a time; a lane starts as many characters early as the longest phrase has, and so is never in another state than one
reader of the whole text would be.

Phrases that one automaton cannot hold are sieved: hashes of their beginnings and of themselves lie in one array of bits,
by which a slice of blocks finds the texts that may be phrases. The distinct ones of these that are none, by a join with
the phrases, are few: they are broadcast, and the blocks are read again without them. Where they are many, blocks are
written with their places and joined with the phrases found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from ..cluster import kept, ship
from . import spans as S
from .trie import Trie

#: Bits of a sieve for each phrase or beginning, and in all, at most; how many of them a beginning and a phrase set.
SIEVE_BITS, MOST_BITS, SIEVE_HASHES, PHRASE_HASHES = 16, 1 << 30, 2, 10
#: Texts that the sieve lets through though they are no phrases, and their characters, that are broadcast at most.
FALSE_TEXTS, FALSE_CHARS = 1 << 19, 1 << 24
#: Lengths of the beginnings of phrases that are looked for first, then each twice as long as the one before.
FIRST_HEAD = 4

#: Characters of phrases in one automaton (each is a node of about 24 bytes at most), and of a lane, at least.
AUTOMATON_CHARS, LANE_CHARS = 1 << 21, 256


class Automaton(Trie):
    """Phrases with, for each node, ``fail`` (the node of its longest other suffix), ``longest`` (length of the longest
    phrase that ends there), and ``opens`` (the root's edges by character)."""

    def __init__(self, phrases: list[str]):
        super().__init__(sorted({p for p in phrases if p}))
        self.fail, self.longest, self.opens = np.zeros(self.size, np.int32), np.zeros(self.size, np.int32), np.zeros(self.width, np.int32)
        for depth, (a, b) in enumerate(self.levels):
            parent, char = np.divmod(self.edges[a - 1 : b - 1], self.width)
            if depth == 0:
                self.opens[char] = np.arange(a, b)
            else:
                self.fail[a:b] = self._step(self.fail[parent], char)
            self.longest[a:b] = np.where(self.word[a:b] >= 0, depth + 1, self.longest[self.fail[a:b]])

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Where each lane goes from its node with its character."""
        out = self.opens[char]
        lane = np.flatnonzero((node > 0) & (char > 0))
        at, char = node[lane], char[lane].astype(np.int64)
        while len(lane):
            child = self.children(at, char)
            hit = child > 0
            out[lane[hit]] = child[hit]
            at = self.fail[at]
            on = ~hit & (at > 0)
            lane, at, char = lane[on], at[on], char[on]
        return out

    def ends(self, text: str) -> np.ndarray:
        """For each character, the length of the longest phrase that ends with it (0: none)."""
        if not text or not self.depth:
            return np.zeros(len(text), np.int32)
        own = self.numbers(text)
        size, early = max(LANE_CHARS, self.depth), self.depth - 1
        lanes = -(-len(own) // size)
        chars = np.zeros(early + lanes * size, np.int32)
        chars[early : early + len(own)] = own
        rows = np.lib.stride_tricks.as_strided(chars, (early + size, lanes), (chars.itemsize, chars.itemsize * size))
        node, out = np.zeros(lanes, np.int32), np.zeros((lanes, size), np.int32)
        for i in range(early + size):
            node = self._step(node, rows[i])
            if i >= early:
                out[:, i - early] = self.longest[node]
        return out.ravel()[: len(own)]

    def spans(self, text: str) -> np.ndarray:
        """Rows of start and end whose union is that of all occurrences: at each end that of the longest phrase."""
        size = self.ends(text)
        at = np.flatnonzero(size)
        return np.stack([at + 1 - size[at], at + 1], axis=1).astype(np.int64)


def automata(phrases: DataFrame, term: str = "term", most: int = AUTOMATON_CHARS) -> Iterator[Automaton]:
    """Automata that hold the phrases of a table, each of about ``most`` characters at most, one after another.

    The table's characters are counted before any phrase is fetched. Null phrases, and those of nothing but white space
    and punctuation, are left out.
    """
    terms = phrases.where(F.col(term).isNotNull()).select(F.col(term).alias("term")).distinct()
    chars = terms.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    parts = -(-chars // most)
    terms = kept(terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(max(parts, 1)))).repartition("part")) if parts > 1 else terms.withColumn("part", F.lit(0))
    for part in range(parts):
        yield Automaton(S._phrases(tuple(r.term for r in terms.where(F.col("part") == part).collect())))


def with_phrases(blocks: DataFrame, phrases: DataFrame, full: bool = False, flag: str = "user_kept", term: str = "term", most: int = AUTOMATON_CHARS) -> DataFrame:
    """``blocks`` (with ``units array<string>``) with ``flag``: for each unit, whether phrases of the table cover it, in part
    or (``full``) wholly.

    Phrases are compared in the folded form without white space and punctuation, over the borders of units but not of
    blocks; occurrences may overlap. Units without characters in that form are never covered. Null units are empty; a
    null block has a null flag. A column named ``flag`` is replaced. Without phrases nothing is covered.

    Phrases of up to ``most`` characters are broadcast as an automaton. More of them are sieved and joined
    (``_sieve_of``): the blocks are read twice, however many phrases there are, and neither written nor shuffled as long
    as the sieve lets few other texts through.
    """
    spark = blocks.sparkSession
    ship(spark)
    held = "_held"
    while any(c in blocks.columns for c in (held, held + "_slice", held + "_texts")):
        held += "_"
    blocks = blocks.drop(flag)
    terms = phrases.where(F.col(term).isNotNull()).select(F.col(term).alias("term"))
    # repeated phrases count each time here, so a table within the bound is small without a shuffle
    if terms.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0] > most:
        forms = _forms_of(terms)
        sieve = _sieve_of(forms)
        if sieve is not None:
            shared = spark.sparkContext.broadcast(sieve)
            none = _no_phrases(blocks, shared, forms)
            if none is None:
                return _judged(*_sieved(blocks, shared, forms, held), held, full, flag)
            return _passed(blocks, shared, spark.sparkContext.broadcast(none), full, flag)
    else:
        for automaton in automata(phrases, term, most):
            return _flagged(_searched(blocks, spark.sparkContext.broadcast(automaton), held), held, full, flag)
    return blocks.withColumn(flag, F.transform("units", lambda u: F.lit(False)))


def _joined(batch: pa.RecordBatch) -> tuple[S.Joined, np.ndarray]:
    """The units of a slice one after another, folded, and where each block's units begin."""
    offsets, column = S.offsets_of_batch(batch)
    return S.Joined(S.Units.of_array(column.flatten()).phrases, S.block_breaks(offsets)), offsets


def _searched(blocks: DataFrame, shared, held: str) -> DataFrame:
    """``blocks`` with the places (start, end, .. in the block's joined text) that ``shared`` finds as ``held``."""
    schema = StructType([*blocks.schema.fields, StructField(held, ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for whole in batches:
            for batch in S.slices_of(whole):
                joined, offsets = _joined(batch)
                begins = joined.block_starts(offsets)
                found = shared.value.spans(joined.text)
                block = np.searchsorted(begins, found[:, 0], "right") - 1
                found = found - begins[block][:, None]
                ends = np.searchsorted(block, np.arange(len(begins)), "right")
                lists = [found[a:b].ravel() for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
                columns = [*(batch.column(i) for i in range(batch.num_columns)), pa.array([x.tolist() for x in lists], out.field(held).type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return blocks.mapInArrow(run, schema)


def _flagged(found: DataFrame, held: str, full: bool, flag: str) -> DataFrame:
    """``found`` with ``flag`` in place of ``held``."""
    kept_fields = [f for f in found.schema.fields if f.name != held]
    schema = StructType([*kept_fields, StructField(flag, ArrayType(BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for whole in batches:
            for batch in S.slices_of(whole):
                joined, offsets = _joined(batch)
                begins = joined.block_starts(offsets)
                places = batch.column(batch.schema.get_field_index(held)).to_pylist()
                spans = [np.array(p or [], np.int64).reshape(-1, 2) + b for p, b in zip(places, begins, strict=True)]
                yield _with_flags(batch, joined, offsets, np.concatenate([np.zeros((0, 2), np.int64), *spans]), full, flag, out)

    return found.mapInArrow(run, schema)


def _forms_of(terms: DataFrame) -> DataFrame:
    """``p``: the distinct forms in which phrases are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = S.phrase_forms(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted({p for p in forms if p and S.MARK not in p}), pa.string())], names=["p"])

    return kept(terms.select("term").mapInArrow(run, "p string").distinct())


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, in 64 bits."""
    out = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _prefixes(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sums by which the hash of any part of a text is told: a part's is its difference over the power at its start."""
    own = (codes.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD6E8FEB86659FD93)
    return np.append(np.uint64(0), np.cumsum((own ^ (own >> np.uint64(29))) * powers[: len(codes)], dtype=np.uint64))


def _mixed(sums: np.ndarray, start: np.ndarray, size: int | np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The hashes of the parts of a text from ``start``, of ``size`` characters."""
    mixed = (sums[start + size] - sums[start]) * inverse[start] + np.uint64(0xA0761D6478BD642F) * np.asarray(size, np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    return mixed ^ (mixed >> np.uint64(29))


def _again(mixed: np.ndarray) -> np.ndarray:
    return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def _inverses(n: int) -> np.ndarray:
    """Powers of the inverse of that odd number."""
    out = np.full(n + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(text: str, spans: np.ndarray) -> np.ndarray:
    """Hashes of parts of a text, rows of start and end; by them the texts of one slice are told apart."""
    codes = _codes(text)
    return _mixed(_prefixes(codes, _powers(len(codes))), spans[:, 0], spans[:, 1] - spans[:, 0], _inverses(len(codes)))


def _heads(longest: int) -> list[int]:
    out, size = [], FIRST_HEAD
    while size < longest:
        out.append(size)
        size *= 2
    return out


class Sieve:
    """Bits of phrases and of their beginnings, and the phrases' lengths."""

    def __init__(self, bits: int, sizes: list[int]):
        self.bits, self.sizes, self.heads = bits, sorted(sizes), _heads(max(sizes))
        self.held = np.zeros(bits // 8, np.uint8)

    def words_of(self, phrases: list[str]) -> np.ndarray:
        """The bits that phrases and their beginnings set."""
        text, size = _codes("".join(phrases)), np.fromiter(map(len, phrases), np.int64, len(phrases))
        start = np.cumsum(size) - size
        sums, inverse = _prefixes(text, _powers(len(text))), _inverses(len(text))
        found = []
        whole = (_mixed(sums, start, size, inverse), PHRASE_HASHES)
        for mixed, times in (whole, *((_mixed(sums, start[size > head], head, inverse), SIEVE_HASHES) for head in self.heads)):
            for _ in range(times):
                found.append((mixed & np.uint64(self.bits - 1)).astype(np.int64))
                mixed = _again(mixed)
        return np.unique(np.concatenate(found))

    def _may(self, sums: np.ndarray, start: np.ndarray, size: int, inverse: np.ndarray, times: int) -> np.ndarray:
        """Those of the starts from which ``size`` characters may be a phrase or a beginning of one."""
        mixed = _mixed(sums, start, size, inverse)
        for _ in range(times):
            at = (mixed & np.uint64(self.bits - 1)).astype(np.int64)
            yes = np.flatnonzero((self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            start, mixed = start[yes], _again(mixed[yes])
        return start

    def spans(self, text: str) -> np.ndarray:
        """Rows of start and end of all parts of a text that may be phrases: those that are, and few others."""
        codes = _codes(text)
        sums, inverse = _prefixes(codes, _powers(len(codes))), _inverses(len(codes))
        start, heads, found = np.arange(len(codes)), self.heads[:], [np.zeros((0, 2), np.int64)]
        for size in self.sizes:
            while heads and heads[0] < size:
                head = heads.pop(0)
                start = self._may(sums, start[start + head <= len(codes)], head, inverse, SIEVE_HASHES)
            at = self._may(sums, start[start + size <= len(codes)], size, inverse, PHRASE_HASHES)
            found.append(np.stack([at, at + size], axis=1))
        return np.concatenate(found)


def _sieve_of(forms: DataFrame) -> Sieve | None:
    spark = forms.sparkSession
    sizes = forms.groupBy(F.length("p").alias("size")).agg(F.count("*").alias("n")).collect()
    if not sizes:
        return None
    heads = _heads(max(r["size"] for r in sizes))
    items = sum(r["n"] * (1 + sum(h < r["size"] for h in heads)) for r in sizes)
    bits = 1 << 13
    while bits < min(items * SIEVE_BITS, MOST_BITS):
        bits *= 2
    sieve = Sieve(bits, [r["size"] for r in sizes])

    def set_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(sieve.bits // 8, np.uint8)
        for batch in batches:
            at = sieve.words_of(batch.column(0).to_pylist())
            np.bitwise_or.at(mine, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        words = mine.view(np.uint64)
        at = np.flatnonzero(words)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)]), pa.array(words[at[k : k + (1 << 16)]].view(np.int64))], names=["at", "word"])

    words = forms.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(set_by, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    table = words.toArrow()
    sieve.held.view(np.int64)[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return sieve


def _places(text: str, sieve: Sieve) -> tuple[np.ndarray, list[str]]:
    """The places in a slice's text that may be phrases, by their start, and their texts, each once."""
    found = sieve.spans(text)
    found = found[np.argsort(found[:, 0], kind="stable")]
    _, first = np.unique(_hashes(text, found), return_index=True)
    return found, [t for a, b in found[first].tolist() if S.MARK not in (t := text[a:b])]


def _no_phrases(blocks: DataFrame, shared, forms: DataFrame) -> list[str] | None:
    """The texts of the blocks that the sieve lets through though they are no phrases; None if they are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in S.slices_of(whole):
                yield pa.RecordBatch.from_arrays([pa.array(_places(_joined(batch)[0].text, shared.value)[1], pa.string())], names=["p"])

    none = kept(blocks.select("units").mapInArrow(run, "p string").distinct().join(forms, "p", "left_anti"))
    n, chars = none.agg(F.count("*"), F.coalesce(F.sum(F.length("p")), F.lit(0))).first()
    return [r.p for r in none.collect()] if n <= FALSE_TEXTS and chars <= FALSE_CHARS else None


def _passed(blocks: DataFrame, shared, none, full: bool, flag: str) -> DataFrame:
    """``blocks`` with ``flag`` by the places that the sieve lets through, without the texts that are no phrases."""
    schema = StructType([*blocks.schema.fields, StructField(flag, ArrayType(BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, others = to_arrow_schema(schema), set(none.value)
        ends = np.cumsum(np.fromiter(map(len, none.value), np.int64, len(none.value)))
        hashes = np.unique(_hashes("".join(none.value), np.stack([ends - np.fromiter(map(len, none.value), np.int64, len(ends)), ends], axis=1)))
        for whole in batches:
            for batch in S.slices_of(whole):
                joined, offsets = _joined(batch)
                spans = shared.value.spans(joined.text)
                marks = np.append(0, np.cumsum(_codes(joined.text) == ord(S.MARK)))
                spans = spans[marks[spans[:, 0]] == marks[spans[:, 1]]]
                # a hash only says where texts are to be compared
                true = np.ones(len(spans), bool)
                for i in np.flatnonzero(np.isin(_hashes(joined.text, spans), hashes)).tolist():
                    true[i] = joined.text[spans[i, 0] : spans[i, 1]] not in others
                yield _with_flags(batch, joined, offsets, spans[true], full, flag, out)

    return blocks.mapInArrow(run, schema)


def _with_flags(batch: pa.RecordBatch, joined: S.Joined, offsets: np.ndarray, spans: np.ndarray, full: bool, flag: str, out: pa.Schema) -> pa.RecordBatch:
    """The columns of ``out``: those of ``batch`` and the units' flags by the spans of their slice."""
    covered = joined.covered(spans)
    flags = (covered == joined.sizes) & (covered > 0) if full else covered > 0
    null = batch.column(batch.schema.get_field_index("units")).is_null().to_numpy(zero_copy_only=False)
    columns = [batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in out if f.name != flag]
    return pa.RecordBatch.from_arrays([*columns, S.per_unit(flags, offsets, null, out.field(flag).type)], schema=out)


def _sieved(blocks: DataFrame, shared, forms: DataFrame, held: str) -> tuple[DataFrame, DataFrame]:
    """``blocks`` with the places that may be phrases and the number of their slice, and the slices' texts that are."""
    more = StructType.fromDDL(f"{held} array<int>, {held}_slice string, {held}_texts array<string>").fields
    schema = StructType([*blocks.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for whole in batches:
            for batch in S.slices_of(whole):
                joined, offsets = _joined(batch)
                begins = joined.block_starts(offsets)
                found, texts = _places(joined.text, shared.value)
                block = np.searchsorted(begins, found[:, 0], "right") - 1
                ends = np.append(0, np.searchsorted(block, np.arange(len(begins)), "right"))
                inside = (found - begins[block][:, None]).astype(np.int32).ravel()
                lists = pa.ListArray.from_arrays(pa.array(ends * 2, pa.int32()), pa.array(inside))
                name = uuid.uuid4().hex
                columns = [*(batch.column(i) for i in range(batch.num_columns)), lists, pa.array([name] * batch.num_rows), pa.array([texts, *[None] * (batch.num_rows - 1)], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    found = kept(blocks.mapInArrow(run, schema))
    texts = found.where(F.col(f"{held}_texts").isNotNull()).select(f"{held}_slice", F.explode(f"{held}_texts").alias("p"))
    # a slice names each text once, so a frequent one has as many rows as there are slices, at most
    true = texts.join(forms.hint("shuffle_hash"), "p", "left_semi").groupBy(F.col(f"{held}_slice").alias("of")).agg(F.collect_list("p").alias("p"))
    return found.drop(f"{held}_texts"), true


def _judged(found: DataFrame, true: DataFrame, held: str, full: bool, flag: str) -> DataFrame:
    """The blocks of each slice with ``flag``, by the places whose texts are phrases."""
    name = f"{held}_slice"
    fields = [f for f in found.schema.fields if f.name not in (held, name)]
    schema = StructType([*fields, StructField(flag, ArrayType(BooleanType()))])

    def run(blocks: pa.Table, true: pa.Table) -> pa.Table:
        out = to_arrow_schema(schema)
        if not blocks.num_rows:
            return out.empty_table()
        phrases = [p for ps in true.column("p").to_pylist() for p in ps]
        batch = blocks.combine_chunks().to_batches()[0]
        joined, offsets = _joined(batch)
        begins = joined.block_starts(offsets)
        column = batch.column(batch.schema.get_field_index(held))
        count = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        spans = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2) + np.repeat(begins, count // 2)[:, None]
        ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
        spans = spans[np.isin(_hashes(joined.text, spans), _hashes("".join(phrases), np.stack([np.append(0, ends)[:-1], ends], axis=1)))]
        return pa.Table.from_batches([_with_flags(batch, joined, offsets, spans, full, flag, out)])

    return found.groupBy(name).cogroup(true.groupBy("of")).applyInArrow(run, schema)

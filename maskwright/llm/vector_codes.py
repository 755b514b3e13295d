"""Product codes of vectors by exact integer Lloyd rounds with heaps of bounds.

Vectors become integers and are cut into parts; each part position has a codebook. Blocks of vectors keep, for each
position and entry, a heap of the parts assigned to it, keyed by slack: the lower bound of the distance to any other
entry minus the upper bound of that to its own. Entries move between rounds, so a slack shrinks by at most what its own
entry and the farthest moved other one drifted. Keys are offset by the drift that an entry has gathered when a part is
pushed; a round pops only parts whose key the drift has since reached, measures those against all entries, and pushes
them again. All other parts are proven to keep their entry, ties included.

Blocks lie in a table that each round reads and writes once. Blocks report sums of what changed alone; sums and
codebooks are as large as the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrow_rows import in_arrow
from .spark_util import cut, with_value

#: Parts of a vector, entries of a codebook, rounds, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of one block, parts that are measured at once, and where larger integers are held.
BLOCK_CELLS, PARTS_AT_ONCE, LARGEST = 1 << 20, 1 << 12, 1 << 62
#: Up to here sums of squares are exact as 64-bit floats; beyond, Python's integers are used.
EXACT = 1 << 53


@dataclass
class Codebooks:
    """Entries (position x entry x component) and the drift that each has gathered so far (position x entry)."""

    entries: np.ndarray
    drift: np.ndarray
    margin: float

    @classmethod
    def first(cls, vectors: np.ndarray, parts: int, largest: int) -> Codebooks:
        """Parts of the given integer vectors, in order. No integer is above ``largest`` in size."""
        n, width = vectors.shape
        entries = vectors.reshape(n, parts, width // parts).transpose(1, 0, 2)
        reach = 2.0 * (largest + 1) * max(width // parts, 1) ** 0.5
        return cls(entries, np.zeros((parts, n)), 1e-9 * (1 + reach))

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries replaced by the floor of their parts' mean, where they have any."""
        used = counts > 0
        means = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], self.entries).astype(self.entries.dtype)
        step = np.sqrt(((means - self.entries) ** 2).sum(axis=2).astype(np.float64)) if means.size else self.drift * 0
        # what an entry's parts can lose: its own step, and the longest of another
        order = np.sort(step, axis=1)
        other = np.where(step == order[:, -1:], order[:, -2:-1] if step.shape[1] > 1 else 0.0, order[:, -1:])
        return Codebooks(means, self.drift + step + other, self.margin)

    def nearest(self, position: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, ties to the lower, and the slack of it."""
        entries = self.entries[position]
        squares = (entries**2).sum(axis=1)
        found, slack = np.zeros(len(parts), np.int64), np.full(len(parts), np.inf)
        for a in range(0, len(parts), PARTS_AT_ONCE):
            x = parts[a : a + PARTS_AT_ONCE]
            distance = squares - 2 * (x @ entries.T) + (x**2).sum(axis=1)[:, None]
            best = distance.argmin(axis=1)
            found[a : a + len(x)] = best
            if len(entries) > 1:
                at = np.arange(len(x))
                own, far = np.sqrt(distance[at, best].astype(np.float64)), distance.astype(np.float64)
                far[at, best] = np.inf
                slack[a : a + len(x)] = np.sqrt(far.min(axis=1)) - own
        return found, slack

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


@dataclass
class Block:
    """Vectors of a block and the heaps of their parts.

    ``order`` holds, position by position, the parts of each entry's heap one after another, as the heap has them,
    ``keys`` their keys, and ``sizes`` (position x entry) how many each heap has.
    """

    cells: np.ndarray
    order: np.ndarray
    keys: np.ndarray
    sizes: np.ndarray

    @classmethod
    def new(cls, cells: np.ndarray, books: Codebooks) -> Block:
        positions, entries, _ = books.entries.shape
        none = np.zeros((positions, 0))
        return cls(cells, none.astype(np.int32), none, np.zeros((positions, entries), np.int32))

    def part(self, position: int) -> np.ndarray:
        width = self.cells.shape[1] // len(self.sizes)
        return self.cells[:, position * width : (position + 1) * width]

    def codes(self) -> np.ndarray:
        """Entry of each vector's part (vector x position)."""
        out = np.zeros((len(self.cells), len(self.sizes)), np.int64)
        for p, order in enumerate(self.order):
            out[order, p] = np.repeat(np.arange(self.sizes.shape[1]), self.sizes[p])
        return out

    def settle(self, books: Codebooks) -> dict[int, int]:
        """Assigns all parts to the entries of ``books``; what that adds to each cell of the sums: components of
        (position, entry), then the number of parts."""
        width = self.cells.shape[1] // len(self.sizes)
        changed = np.zeros((*self.sizes.shape, width + 1), books.entries.dtype if books.entries.dtype == object else np.int64)
        order, keys = [], []
        for p, sizes in enumerate(self.sizes):
            parts, ends = self.part(p), np.cumsum(sizes)
            pairs = list(zip(self.keys[p].tolist(), self.order[p].tolist(), strict=True))
            heaps = [pairs[end - n : end] for end, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            fresh = not len(self.order[p])
            violated, before = (list(range(len(parts))), None) if fresh else ([], [])
            for entry, (heap, limit) in enumerate(zip(heaps, (books.drift[p] + books.margin).tolist(), strict=True)):
                while heap and heap[0][0] <= limit:
                    violated.append(heappop(heap)[1])
                    before.append(entry)
            if violated:
                popped = np.array(violated)
                own = parts[popped]
                entry, slack = books.nearest(p, own)
                pushed = (slack + books.drift[p][entry]).tolist()
                for e, pair in zip(entry.tolist(), zip(pushed, violated, strict=True), strict=True):
                    heaps[e].append(pair) if fresh else heappush(heaps[e], pair)
                if fresh:
                    for heap in heaps:
                        heapify(heap)
                    moved = np.ones(len(popped), bool)
                else:
                    moved = entry != np.array(before)
                    self._add(changed[p], np.array(before)[moved], own[moved], -1)
                self._add(changed[p], entry[moved], own[moved], 1)
            flat = [pair for heap in heaps for pair in heap]
            keys.append([k for k, _ in flat])
            order.append([i for _, i in flat])
            self.sizes[p] = [len(h) for h in heaps]
        self.order, self.keys = np.array(order, np.int32).reshape(len(self.sizes), -1), np.array(keys, np.float64).reshape(len(self.sizes), -1)
        flat = changed.ravel()
        at = np.flatnonzero(flat)
        return dict(zip(at.tolist(), flat[at].tolist(), strict=True))

    @staticmethod
    def _add(sums: np.ndarray, entry: np.ndarray, parts: np.ndarray, sign: int) -> None:
        np.add.at(sums[:, :-1], entry, sign * (parts if sums.dtype == object else parts.astype(np.int64)))
        np.add.at(sums[:, -1], entry, sign)

    def errors(self, books: Codebooks, codes: np.ndarray) -> np.ndarray:
        """Squared distances to the assigned entries, summed over parts."""
        total = 0
        for p in range(len(self.sizes)):
            total = total + ((self.part(p) - books.entries[p][codes[:, p]]) ** 2).sum(axis=1)
        return total


def _integers(vectors: pa.Array, width: int, exact: bool) -> np.ndarray:
    """Scaled components rounded down (vector x component), zeros behind shorter vectors."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    with np.errstate(over="ignore"):
        out[np.arange(width) < sizes[:, None]] = np.floor(values * SCALE)
    return out if exact else np.array([[max(-LARGEST, min(LARGEST, int(x))) for x in np.nan_to_num(row).tolist()] for row in out], object).reshape(out.shape)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, codes`` (entry of each part), ``error`` (squared distances summed over parts) of every vector that
    takes part, and the final codebooks.

    Vectors that are null or hold null or non-finite components take no part. Components are multiplied by 1024 and
    rounded down. A codebook starts as that part of the vectors of smallest ids (equal ids by components, null last),
    in order; with fewer vectors it has fewer entries. Each round assigns every part to the nearest entry, ties to the
    lower, then moves used entries to their parts' mean, rounded down; at last parts are assigned again. Shorter
    vectors end in zeros, up to the least multiple of ``parts`` that holds the longest. Integers beyond 2^62 count as
    that, errors beyond a long as its largest value. Repeated rows have a result each; no vectors give no rows.
    """
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(v.isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    n, longest, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = -(-(longest or 0) // parts) * parts
    largest = int(min((most or 0.0) * SCALE + 1, LARGEST))
    exact = 4 * max(width // parts, 1) * (largest + 1) ** 2 < EXACT
    store = next((t for t in (np.int16, np.int32) if largest < np.iinfo(t).max), np.int64)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()["v"]
    books = Codebooks.first(_integers(first, width, exact), parts, largest)
    state = f"ids array<bigint>, labels array<{kind}>, cells binary, orders binary, keys binary, sizes binary, changed array<bigint>, added array<{'bigint' if exact else 'decimal(38,0)'}>"

    out = f"vec_id bigint, label {kind}, codes array<int>, error bigint"
    packed_schema, out_schema = (to_arrow_schema(StructType.fromDDL(x)) for x in (state, out))

    def packed(ids: pa.Array, labels: pa.Array, block: Block, changed: dict[int, int]) -> pa.RecordBatch:
        schema = packed_schema
        one = lambda values, i: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(schema.types[i])
        whole = [block.cells.astype(store), block.order, block.keys, block.sizes]
        sums = [one(pa.array(list(changed), pa.int64()), 6), one(pa.array(list(changed.values()), schema.types[7].value_type), 7)]
        return pa.RecordBatch.from_arrays([one(ids, 0), one(labels, 1), *(pa.array([x.tobytes()], pa.binary()) for x in whole), *sums], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, BLOCK_CELLS // max(width, 1))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                block = Block.new(_integers(part.column(2), width, exact), books)
                yield packed(part.column(0), part.column(1), block, block.settle(books))

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, Block]]:
        positions, count = books.entries.shape[:2]
        for i in range(batch.num_rows):
            ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
            whole = [np.frombuffer(x, t) if (x := batch.column(c)[i].as_py()) else np.zeros(0, t) for c, t in zip(range(2, 6), (store, np.int32, np.float64, np.int32), strict=True)]
            cells = whole[0].reshape(len(ids), width).astype(np.float64 if exact else object)
            yield ids, labels, Block(cells, whole[1].reshape(positions, -1), whole[2].reshape(positions, -1), whole[3].reshape(positions, count).copy())

    def again(books: Codebooks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, block in blocks(batch):
                    yield packed(ids, labels, block, block.settle(books))

        return run

    def finish(books: Codebooks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema, top = out_schema, np.iinfo(np.int64).max
            for batch in batches:
                for ids, labels, block in blocks(batch):
                    block.settle(books)
                    codes = block.codes()
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.array(codes.ravel().astype(np.int32)))
                    error = [min(int(e), top) for e in np.broadcast_to(block.errors(books, codes), len(codes)).tolist()]
                    columns = [ids, labels, listed, pa.array(error, pa.int64())]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        return run

    now = cut(in_arrow(rows, pack, state)) if n else None
    total = np.zeros((parts, books.entries.shape[1], width // parts + 1), np.int64 if exact else object)
    for i in range(rounds if n else 0):
        sums = now.select(F.explode(F.arrays_zip("changed", "added")).alias("c")).groupBy("c.changed").agg(F.sum("c.added").alias("added"))
        for cell, added in sums.collect():  # at most as many rows as codebooks have components and entries
            total.ravel()[cell] += int(added)
        books = books.moved(total[..., :-1], total[..., -1])
        if i + 1 < rounds:
            now = cut(in_arrow(now, again(books), state))
    if not n:
        return rows.sparkSession.createDataFrame([], out), books
    return cut(in_arrow(now, finish(books), out)), books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels, nulls together. A label may have most rows."""
    held = F.coalesce(F.col("label").cast("string"), F.lit(""))
    keyed = coded.withColumn("label_null", F.col("label").isNull()).withColumn("label_key", held)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = keyed.groupBy("label_null", "label_key").agg(total.alias("label_error"), F.count("*").alias("times"))
    return with_value(keyed, sums, "label_null", "label_key").drop("label_null", "label_key")

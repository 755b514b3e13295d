"""Exact n-gram Jaccard join in metric space.

One minus the Jaccard similarity is a metric, but unrelated texts all lie at distance one from any pivot, where
Voronoi regions cannot part them. So candidates come first, exactly: of two linked sets, the rarest common shingle is
among the few rarest of both, in any order that all sets keep. The order is by estimated frequency: blocks of
documents send the cells of their shingles to ranges of hashes, these merge the counts, and each block gets back the
classes of its cells that hold more than one. Shingles of one set alone are rarest and cannot be common. Sets that
share one of their rarest shingles are joined into clusters (no linked pair lies across clusters).

Clusters are the first regions. In each, some sets become pivots, every set of the region measures its distance to
them, and sets within reach are linked. Pivots have met all of their region then and leave it. Where the
triangle-inequality windows replicate few sets, the region is divided into the pivots' Voronoi regions, which go on by
themselves in the same way. Regions that fit a task do so within one, larger ones over many tasks: in a few turns pivots are
drawn, then all sets that are not yet connected are pivots of a last turn, dealt in pairs of chunks, so turns do not grow
with a region. Sets that are already connected need no comparison, so a group of thousands of near copies never costs all
its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import ship
from .arrow_rows import flat_bytes, frugal, in_arrow, slices
from .components import connected_components
from .spark_util import cut, is_small, small_side, with_value
from .substring_dedup import answer, by_range, pack, range_of, unpack
from .words import Words, mix

#: Words in a shingle; texts are linked when DEN * intersection >= NUM * union.
SHINGLE, NUM, DEN = 5, 80, 100
#: A region of at most so many sets and shingles is joined within one task.
LOCAL_SETS, LOCAL_SHINGLES = 1 << 13, 4 << 20
#: Pivots of a round in one region, and their shingles, at most.
PIVOTS, PIVOT_SHINGLES = 40, 8 << 20
#: Turns in which pivots are drawn from regions beyond one task; the turn after them is the last.
TURNS = 2
#: A region is divided when its windows hold each set at most so many times.
REPLICATION = 2.0
#: Shingles in a block, in a range of hashes, and rarest shingles in a bucket, about; bits of a cell within its range.
BLOCK_SHINGLES, RANGE_SHINGLES, BUCKET_KEYS, CELL_BITS = 1 << 20, 2 << 20, 1 << 20, 24
_TAG = np.uint64(0x9E3779B97F4A7C15)


class Limit(NamedTuple):
    """Sets are linked when ``den * intersection >= num * union``."""

    num: int
    den: int


def shingle_sets(part: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of ``part``; a shorter text is one shingle as a whole."""
    flat, offsets = flat_bytes(part, "text")
    words = Words(flat, offsets, lower=True)
    n_words = np.bincount(words.text, minlength=part.num_rows)
    first = np.append(0, np.cumsum(n_words))
    full = words.windows(size)
    short = {k: words.windows(k) ^ np.uint64(k) for k in range(1, size) if (n_words == k).any()}
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        n = b - a
        out.append(np.unique(full[a : b - size + 1]) if n >= size else short[n][a : a + 1] if n else np.zeros(0, np.uint64))
    return out


def identity(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit values that name a set."""
    both = (mix(shingles + _TAG).sum(dtype=np.uint64), mix(shingles ^ _TAG).sum(dtype=np.uint64))
    return tuple(int(x) for x in mix(np.array(both, np.uint64)).view(np.int64))


def _chain(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with their least node, and distinct edges that join all nodes of each key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    same = keys[1:] == keys[:-1]
    differ = same & (nodes[1:] != nodes[:-1])
    edges = np.unique(np.stack([nodes[:-1][differ], nodes[1:][differ]], 1), axis=0) if differ.any() else np.zeros((0, 2), np.int64)
    first = np.append(True, ~same) if len(keys) else np.zeros(0, bool)
    return keys[first], nodes[first], edges


def _numbered(nodes: np.ndarray) -> bytes:
    """How many distinct nodes there are, these, and each place's number among them in as few bytes as they need."""
    distinct, number = np.unique(nodes, return_inverse=True)
    kind = np.uint16 if len(distinct) <= 1 << 16 else np.uint32
    return np.int64(len(distinct)).tobytes() + distinct.tobytes() + number.astype(kind).tobytes()


def _named(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    number = np.frombuffer(packed, np.uint16 if n <= 1 << 16 else np.uint32, offset=8 * (n + 1))
    return np.frombuffer(packed, np.int64, n, 8)[number]


_EDGES = "a long, b long"
_SENT = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("nodes", pa.binary()), ("edges", pa.binary())])


def _codes(shingles: np.ndarray, ranges: int) -> np.ndarray:
    """Range and cell of each shingle in one integer."""
    return (range_of(shingles, ranges) << np.uint64(CELL_BITS)) | (mix(shingles) >> np.uint64(64 - CELL_BITS))


def _named_sets(table: pa.Table, size: int, wanted: set[int] | None = None) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Nodes and sets of ``table`` slice by slice; rows whose text is not the node's are left out, as hashes may collide.

    With ``wanted`` the rows have no nodes, and the first row of each wanted one stands for it.
    """
    left = None if wanted is None else set(wanted)
    for batch in table.to_batches():
        for part in slices(batch, "text"):
            sets = shingle_sets(part, size)
            if left is None:
                nodes = part.column(part.schema.get_field_index("node")).to_pylist()
                held = [i for i, s in enumerate(sets) if identity(s)[0] == nodes[i]]
            else:
                nodes, held = [identity(s)[0] if len(s) else None for s in sets], []
                for i, node in enumerate(nodes):
                    if node in left:
                        left.remove(node)
                        held.append(i)
            yield [nodes[i] for i in held], [sets[i] for i in held]


def _wanted(table: pa.Table) -> set[int]:
    return {n for r, p in zip(table["range"].to_pylist(), table["packed"].to_pylist(), strict=True) if r < 0 for n in np.frombuffer(p, np.int64).tolist()}


def _rarest(sets: list[np.ndarray], classes: np.ndarray, limit: Limit) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of which linked sets share one, and the set of each; ``classes`` are those of all shingles.

    A set of n shingles that is linked shares at least n * num / den of them, so its rarest common shingle is among
    its n - ceil(n * num / den) + 1 rarest. Those of class zero are in no other set.
    """
    keys, owners, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for i, s in enumerate(sets):
        own = classes[start : start + len(s)]
        start += len(s)
        shared = np.flatnonzero(own)
        take = len(s) + (-limit.num * len(s)) // limit.den + 1 - (len(s) - len(shared))
        if take > 0 and len(shared):
            first = np.lexsort((s[shared], own[shared]))[:take]
            keys.append(s[shared[first]])
            owners.append(np.full(len(first), i))
    return np.concatenate(keys), np.concatenate(owners)


def _to_buckets(keys: np.ndarray, nodes: np.ndarray, n_buckets: int) -> pa.Table:
    """Rows for the buckets of ``keys``. A key is sent once: its nodes here are joined by edges, which go along."""
    keys, nodes, edges = _chain(keys, nodes)
    bucket = range_of(keys, n_buckets).astype(np.int64)
    found, first = np.unique(bucket, return_index=True)
    spans = list(zip(first.tolist(), np.append(first[1:], len(keys))[: len(first)].tolist(), strict=True))
    columns = [[keys[a:b].tobytes() for a, b in spans], [_numbered(nodes[a:b]) for a, b in spans], [b""] * len(spans)]
    to = (edges[:, 0].view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    own, first = np.unique(to[order], return_index=True)
    for a, b in zip(first.tolist(), np.append(first[1:], len(to))[: len(first)].tolist(), strict=True):
        for column, value in zip(columns, (b"", b"", edges[order[a:b]].tobytes()), strict=True):
            column.append(value)
    return pa.Table.from_arrays([pa.array(np.append(found, own), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], schema=_SENT)


def _least_parts(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def _blocks(spark: SparkSession, total: int) -> int:
    """Blocks into which sets of ``total`` shingles are dealt."""
    return max(_least_parts(spark), -(-total // BLOCK_SHINGLES))


def _candidates(texts: DataFrame, size: int, limit: Limit, total: int, wanted: DataFrame | None = None) -> DataFrame:
    """Edges ``a, b`` between sets that share one of their rarest shingles; they connect every linked pair of sets.

    ``texts`` holds ``block, node, text``, each set once, or ``block, text`` of all rows and ``wanted`` the ``block, node`` of
    each set, whose row is then found within the block; ``total`` is the number of their shingles. The answers to
    all blocks together have at most as many rows as there are shingles; at far larger inputs raise BLOCK_SHINGLES and
    RANGE_SHINGLES, so that blocks x ranges stays well below that.
    """
    least, n_blocks = _least_parts(texts.sparkSession), _blocks(texts.sparkSession, total)
    n_ranges = max(least, -(-total // RANGE_SHINGLES))
    n_buckets = max(least, int(total * (limit.den - limit.num) / limit.den) // BUCKET_KEYS)
    sent, apart = "range long, block long, packed binary", wanted is not None

    def touch(key: tuple, table: pa.Table, own: set[int] | None = None) -> pa.Table:
        found = [np.zeros(0, np.uint64), *(_codes(s, n_ranges) for _, sets in _named_sets(table, size, own) for s in sets)]
        codes, times = np.unique(np.concatenate(found), return_counts=True)
        cells, times = (codes & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint32), np.minimum(times, 255).astype(np.uint8)
        return by_range(key[0].as_py(), codes, codes >> np.uint64(CELL_BITS), lambda a, b: pack(cells[a:b]) + times[a:b].tobytes())

    def classify(table: pa.Table) -> pa.Table:
        counts, rows = np.zeros(1 << CELL_BITS, np.int32), []
        for block, packed in zip(table["block"].to_pylist(), table["packed"].to_pylist(), strict=True):
            n = len(packed) // 5
            cells = unpack(packed[: 4 * n], np.uint32)
            counts[cells] += np.frombuffer(packed, np.uint8, n, 4 * n)
            rows.append((block, cells))
        back = []
        for block, cells in rows:
            cells = cells[counts[cells] > 1]
            if len(cells):
                back.append((block, pack(cells) + np.floor(2 * np.log2(counts[cells])).astype(np.uint8).tobytes()))
        return answer(table["range"][0].as_py(), back)

    def rarest(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        codes, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        of = _wanted(right) if apart else None
        right = right.filter(pc.greater_equal(right["range"], 0))
        for r, packed in zip(right["range"].to_pylist(), right["packed"].to_pylist(), strict=True):
            n = len(packed) // 5
            codes.append(unpack(packed[: 4 * n], np.uint32).astype(np.uint64) | np.uint64(r << CELL_BITS))
            kinds.append(np.frombuffer(packed, np.uint8, n, 4 * n))
        codes, kinds = np.concatenate(codes), np.concatenate(kinds)
        order = np.argsort(codes)
        codes, kinds = codes[order], kinds[order]
        keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for names, sets in _named_sets(left, size, of) if len(codes) else ():
            own = _codes(np.concatenate([np.zeros(0, np.uint64), *sets]), n_ranges)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            k, o = _rarest(sets, np.where(codes[at] == own, kinds[at], 0), limit)
            keys.append(k)
            nodes.append(np.array(names, np.int64)[o])
        return _to_buckets(np.concatenate(keys), np.concatenate(nodes), n_buckets)

    def join(table: pa.Table) -> pa.Table:
        keys, edges = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("keys", np.uint64), ("edges", np.int64)))
        nodes = np.concatenate([np.zeros(0, np.int64), *(_named(p) for p in table["nodes"].to_pylist() if p)])
        edges = np.concatenate([_chain(keys, nodes)[2], edges.reshape(-1, 2)])
        edges = np.unique(edges, axis=0) if len(edges) else edges
        return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})

    blocks = texts.groupBy("block")
    if not apart:
        touched = blocks.applyInArrow(frugal(lambda key, rows: touch(key, rows)), sent)
    else:
        # a row of range -1 names a block's sets
        named = wanted.groupBy("block").applyInArrow(lambda key, t: by_range(key[0].as_py(), np.full(1, -1), np.full(1, -1), lambda a, b: t["node"].to_numpy().tobytes()), sent)
        named = cut(named)
        touched = blocks.cogroup(named.groupBy("block")).applyInArrow(frugal(lambda key, rows, of: touch(key, rows, _wanted(of))), sent)
    classes = touched.groupBy("range").applyInArrow(frugal(classify), sent)
    if apart:
        classes = classes.unionByName(named)
    keys = blocks.cogroup(classes.groupBy("block")).applyInArrow(frugal(rarest), "bucket long, keys binary, nodes binary, edges binary")
    return keys.groupBy("bucket").applyInArrow(frugal(join), _EDGES)


def _to_pivots(pivots: list[np.ndarray], sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set (rows) with each pivot."""
    universe = np.unique(np.concatenate(pivots))
    table = np.zeros((len(universe) + 1, len(pivots)), np.uint8)
    for j, p in enumerate(pivots):
        table[np.searchsorted(universe, p), j] = 1
    out, start = np.zeros((len(sets), len(pivots)), np.int64), 0
    while start < len(sets):
        stop, held = start, 0
        while stop < len(sets) and (stop == start or held + len(sets[stop]) <= 1 << 19):
            held, stop = held + len(sets[stop]), stop + 1
        flat = np.concatenate(sets[start:stop])
        at = np.searchsorted(universe, flat)
        at[universe[np.minimum(at, len(universe) - 1)] != flat] = len(universe)
        first = np.cumsum([0, *(len(s) for s in sets[start : stop - 1])])
        out[start:stop] = np.add.reduceat(table[at], first, axis=0, dtype=np.int64)
        start = stop
    return out


def _merge(label: np.ndarray, members: np.ndarray) -> None:
    """Gives all labels of ``members`` the least of them."""
    labels = np.unique(label[members])
    if len(labels) > 1:
        label[np.isin(label, labels)] = labels[0]


def _join_region(sets: list[np.ndarray], limit: Limit) -> np.ndarray:
    """Label of each set's component, by pivots and windows alone.

    A region's pivots meet all of it and then leave it. Where the windows around them replicate few sets, the region
    is divided into the pivots' own; a small region's sets are all pivots of one turn. Sets of the largest component
    need not become pivots: those outside meet them as pivots themselves.
    """
    sizes, label = np.array([len(s) for s in sets], np.int64), np.arange(len(sets))
    reach, dice = (limit.den - limit.num) / limit.den, np.random.default_rng(len(sets))
    todo = [np.arange(len(sets))]
    while todo:
        region = todo.pop()
        names, times = np.unique(label[region], return_counts=True)
        outside = np.flatnonzero(label[region] != names[np.argmax(times)])
        if not len(outside):
            continue
        own = sizes[region]
        some = dice.permutation(outside)[:PIVOTS]
        some = some[: max(1, int((np.cumsum(own[some]) <= PIVOT_SHINGLES).sum()))]
        both = _to_pivots([sets[i] for i in region[some]], [sets[i] for i in region])
        union = own[:, None] + own[some][None, :] - both
        linked, distance = limit.den * both >= limit.num * union, 1 - both / union
        for j in range(len(some)):
            _merge(label, region[linked[:, j]])
        left = np.ones(len(region), bool)
        left[some] = False
        windows = (distance <= distance.min(1, keepdims=True) + 2 * reach + 1e-9)[left]
        left = region[left]
        if windows.sum() <= REPLICATION * len(left):
            todo += [left[w] for w in windows.T if w.sum() > 1]
        elif len(left) > 1:
            todo.append(left)
    return label


def _stars(nodes: list[int], sets: list[np.ndarray], limit: Limit) -> list[tuple[int, int]]:
    """Each set of a region with the root of its linked sets, if that is another one."""
    return [(nodes[i], nodes[r]) for i, r in enumerate(_join_region(sets, limit).tolist()) if r != i]


def _compare_regions(members: DataFrame, limit: Limit, sets_of: Callable[[pa.Table], Iterator[tuple[list[int], list[np.ndarray]]]]) -> DataFrame:
    """Linked sets within regions of bounded size, as edges ``a, b``; ``sets_of`` gives nodes and sets of some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held = None, {}
        for batch in batches:
            regions = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, regions[1:] != regions[:-1])[: len(regions)]).tolist()
            out: list[tuple[int, int]] = []
            for start, stop in zip(starts, [*starts[1:], len(regions)], strict=True):
                if regions[start] != region:
                    if len(held) > 1:
                        out += _stars(list(held), list(held.values()), limit)
                    region, held = regions[start], {}
                for nodes, sets in sets_of(pa.Table.from_batches([batch.slice(start, stop - start)])):
                    held.update(zip(nodes, sets, strict=True))
            yield _edge_batch(out)
        if len(held) > 1:
            yield _edge_batch(_stars(list(held), list(held.values()), limit))

    return in_arrow(members.repartition("region").sortWithinPartitions("region"), run, _EDGES)


def _packed_sets(table: pa.Table) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    yield table["node"].to_pylist(), [np.frombuffer(p, np.uint64) for p in table["shingles"].to_pylist()]


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def _from_middle(sets: list[np.ndarray]) -> list[np.ndarray]:
    """By what each set differs from the middle one, which holds what more than half of the sets do, as sorted numbers from
    one on; zero is in all. Near copies differ from it by little, and their intersections follow from that."""
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    middle = 2 * np.bincount(number) > len(sets)
    inner = np.flatnonzero(middle)
    return [np.concatenate([[0], 1 + np.sort(np.concatenate([own[~middle[own]], np.setdiff1d(inner, own, True)]))]) for own in np.split(number, ends[:-1])]


def _join_chunks(sets: list[np.ndarray], side: np.ndarray, comps: np.ndarray, main: int, limit: Limit) -> np.ndarray:
    """Label of each set's component by the links between the sets of two sides, or within a single one.

    Sets outside the component ``main`` are pivots in turn: they meet all of the other side that was no pivot yet. One
    that a link brought into it need be none: those outside meet it as pivots themselves.
    """
    names, label = np.unique(comps, return_inverse=True)
    start = np.flatnonzero(comps == main)[:1]
    sizes, apart = np.array([len(s) for s in sets], np.int64), _from_middle(sets)
    differ, met, single = np.array([len(d) for d in apart], np.int64) - 1, np.zeros(len(sets), bool), len(np.unique(side)) == 1
    for one in np.unique(side).tolist():
        while True:
            able = (side == one) & ~met
            some = np.flatnonzero(able & (label != label[start[0]]) if len(start) else able)[:PIVOTS]
            if not len(some):
                break
            met[some] = True
            others = ~met & ((side != one) | single)
            others[some] = single
            others = np.flatnonzero(others)
            if not len(others):
                continue
            shared = _to_pivots([apart[i] for i in some], [apart[i] for i in others]) - 1
            # what two sets do not share is what they differ by from any third, less twice what they differ by alike
            total = sizes[others][:, None] + sizes[some][None, :]
            both = (total - differ[others][:, None] - differ[some][None, :]) // 2 + shared
            linked = limit.den * both >= limit.num * (total - both)
            for j, i in enumerate(some):
                _merge(label, np.append(others[linked[:, j]], i))
    first = np.full(len(names), len(sets))
    np.minimum.at(first, label, np.arange(len(sets)))
    return first[label]


def _compare_chunks(members: DataFrame, limit: Limit) -> DataFrame:
    """Links of regions beyond one task, as edges ``a, b``, with all sets outside the main component as pivots.

    A region's sets are dealt into chunks of half of what a task may hold; a task has two of them, or one by itself.
    ``members`` has the region's ``sets``, ``all_n`` and ``main`` as well.
    """

    def run(table: pa.Table) -> pa.Table:
        nodes, packed = table["node"].to_pylist(), table["shingles"].to_pylist()
        sets = [np.frombuffer(p, np.uint64) for p in packed]
        label = _join_chunks(sets, table["chunk"].to_numpy(), table["comp"].to_numpy(), table["main"][0].as_py(), limit)
        found = _edge_batch([(nodes[i], nodes[r]) for i, r in enumerate(label.tolist()) if r != i])
        return pa.Table.from_batches([found])

    chunks = F.ceil(F.greatest(2 * F.col("sets") / LOCAL_SETS, 2 * F.col("all_n") / LOCAL_SHINGLES))
    dealt = members.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), "chunks"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pairs = pairs.select("region", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "shingles", "comp", "main")
    return pairs.groupBy("region", "i", "j").applyInArrow(frugal(run), _EDGES)


_MEMBER = "region long, node long, n long, shingles binary, comp long"


def _measure(members: DataFrame, limit: Limit, reach: float) -> DataFrame:
    """Each member with the pivots it is linked to, and those whose window holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            linked, windows = [], []
            names = batch.schema.names
            for region, packed, pivots in zip(*(batch.column(names.index(c)) for c in ("region", "shingles", "pivots")), strict=True):
                r = region.as_py()
                if r not in known:
                    known.clear()
                    own = [(p["node"], np.frombuffer(p["shingles"], np.uint64)) for p in pivots.as_py()]
                    flat = np.concatenate([s for _, s in own])
                    universe = np.unique(flat)
                    table = np.zeros((len(universe) + 1, len(own)), np.uint8)
                    table[np.searchsorted(universe, flat), np.repeat(np.arange(len(own)), [len(s) for _, s in own])] = 1
                    known[r] = ([n for n, _ in own], np.array([len(s) for _, s in own]), universe, table)
                nodes, sizes, universe, table = known[r]
                mine = np.frombuffer(packed.as_py(), np.uint64)
                at = np.searchsorted(universe, mine)
                at[universe[np.minimum(at, len(universe) - 1)] != mine] = len(universe)
                both = table[at].sum(0, dtype=np.int64)
                union = len(mine) + sizes - both
                distance = 1 - both / union
                linked.append([n for n, yes in zip(nodes, limit.den * both >= limit.num * union, strict=True) if yes])
                windows.append([n for n, d in zip(nodes, distance, strict=True) if d <= distance.min() + 2 * reach + 1e-9])
            kept = [batch.column(names.index(c.split()[0])) for c in _MEMBER.split(", ")]
            kinds = [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, k) for x, k in zip((linked, windows), kinds, strict=True))], names=[*(c.split()[0] for c in _MEMBER.split(", ")), "linked", "windows"])

    return in_arrow(members, run, f"{_MEMBER}, linked array<long>, windows array<long>")


def _fits() -> Column:
    """Whether a region of ``sets`` sets and ``all_n`` shingles is joined within one task."""
    return (F.col("sets") <= LOCAL_SETS) & (F.col("all_n") <= LOCAL_SHINGLES)


def _pivot_rounds(members: DataFrame, limit: Limit) -> list[DataFrame]:
    """Edges that join the linked sets of all regions, in a few turns; see the module's text."""
    found: list[DataFrame] = []
    turn = 0
    while True:
        per_comp = members.groupBy("region", "comp").agg(F.count("*").alias("sets"), F.sum("n").alias("n"))
        stats = per_comp.groupBy("region").agg(F.sum("sets").alias("sets"), F.sum("n").alias("all_n"), F.max(F.struct("sets", "comp")).alias("main"))
        # sets outside the largest known component are compared to all; those inside are connected already
        stats = stats.select("region", "sets", "all_n", F.col("main.comp").alias("main"), (F.col("sets") - F.col("main.sets")).alias("open"))
        stats = small_side(stats.where("open > 0"))
        little = _fits()
        joined = members.join(stats, "region")
        own = joined.where(little).select("region", "node", "shingles")
        found.append(cut(_compare_regions(own, limit, _packed_sets)))
        large = cut(joined.where(~little))
        if large.isEmpty():
            return found
        if turn == TURNS:
            return [*found, cut(_compare_chunks(large, limit))]
        want = F.greatest(F.lit(1), F.least(F.lit(PIVOTS), (PIVOT_SHINGLES * F.col("sets") / F.col("all_n")).cast("int")))
        dice = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        able = large.where(F.col("comp") != F.col("main")).withColumn("dice", dice).withColumn("want", want)
        # the smallest dice of a region is drawn in any case: a region without pivots would lose its links
        sure = small_side(able.groupBy("region").agg(F.min(F.struct("dice", "node"))["node"].alias("sure")))
        drawn = able.join(sure, "region").where((F.col("dice") < 1.5 * F.col("want") / F.col("open")) | (F.col("node") == F.col("sure"))).drop("sure")
        drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("region").orderBy("dice", "node"))).where("place <= want")
        pivots = small_side(drawn.groupBy("region").agg(F.collect_list(F.struct("node", "shingles")).alias("pivots")), 64)
        reach = (limit.den - limit.num) / limit.den
        measured = cut(_measure(large.drop("sets", "all_n", "main", "open").join(pivots, "region"), limit, reach))
        links = measured.select(F.col("node").alias("a"), F.explode("linked").alias("b"))
        found.append(links)
        comps = measured.select("node", "comp").distinct()
        pairs = links.join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
        merged = connected_components(pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        is_pivot = F.array_contains("linked", F.col("node"))  # a pivot is at distance 0 from itself
        members = measured.join(merged.withColumnRenamed("node", "comp"), "comp", "left")
        # pivots have met all of their region and leave it
        members = members.withColumn("comp", F.coalesce("component", "comp")).where(~is_pivot)
        spread = measured.where(~is_pivot).groupBy("region").agg((F.sum(F.size("windows")) / F.count("*") <= REPLICATION).alias("divide"))
        into = F.when(F.col("divide"), F.transform("windows", lambda p: F.xxhash64("region", F.lit(turn), p))).otherwise(F.array("region"))
        members = members.join(small_side(spread), "region").withColumn("region", F.explode(into))
        members = cut(members.select(*(c.split()[0] for c in _MEMBER.split(", "))))
        turn += 1


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A document's set holds its distinct
    shingles of ``shingle`` words, or its whole text as one if it has fewer words. Documents link when
    ``den * intersection >= num * union``; ``component_id`` is the smallest id that can be reached by links, itself
    included. Null and empty texts have no shingles and link with nothing. Null ids count only where a component has
    no other. An empty table gives an empty result; other columns are ignored. Shingles and sets are told apart by
    64-bit hashes.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # ids may be null or repeat: a row is told by its id and its text's hash
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("said"), text.alias("text"))
    limit = Limit(num, den)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part, shingle)
                kept = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "said")]
                columns = [*kept, pa.array([len(s) for s in sets], pa.int64()), pa.array([identity(s)[0] for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "said", "n_shingles", "node"])

    named = cut(in_arrow(rows, name, f"doc_id {kind}, said long, n_shingles long, node long"))
    repeat = not named.groupBy("doc_id", "said").count().where("count > 1").isEmpty()

    def texts(nodes: DataFrame, *more: str) -> DataFrame:
        """The texts of the rows that stand for ``nodes``, each once."""
        same = F.col("doc_id").eqNullSafe(F.col("of.doc_id")) & (F.col("said") == F.col("of.said"))
        own = rows.join(small_side(nodes), same).select("node", *more, "text")
        return own.dropDuplicates(["node"]) if repeat else own

    # one document stands for all that have the same set
    least_row = F.min(F.struct("doc_id", "said"))
    of_id = F.min("doc_id").alias("least_id")
    chosen = cut(named.where("n_shingles > 0").groupBy("node").agg(least_row.alias("of"), of_id, F.max("n_shingles").alias("n"), F.count("*").alias("rows")))
    total = chosen.agg(F.sum("n")).first()[0] or 0
    n_blocks = _blocks(docs.sparkSession, total)
    nodes = chosen.select("of", "node")
    if repeat or is_small(nodes):
        block = F.pmod(F.xxhash64("node"), F.lit(n_blocks)).alias("block")
        edges = _candidates(texts(nodes).select(block, "node", "text"), shingle, limit, total)
    else:
        # a join would shuffle all texts once more, and sort them: each block finds its sets' rows by itself
        block = lambda of: F.pmod(F.xxhash64(f"{of}doc_id", f"{of}said"), F.lit(n_blocks)).alias("block")
        edges = _candidates(rows.select(block(""), "text"), shingle, limit, total, nodes.select(block("of."), "node"))
    clusters = connected_components(edges)
    placed = chosen.join(clusters.withColumnRenamed("component", "region"), "node")
    sizes = placed.groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("all_n"))
    placed = cut(placed.join(sizes, "region").select("of", "node", "region", _fits().alias("fits")))

    local = texts(placed.where("fits").drop("fits"), "region").select("region", "node", "text")
    links = _compare_regions(local, limit, lambda table: _named_sets(table, shingle))
    large = placed.where("not fits").drop("fits")
    if not large.isEmpty():
        members = cut(in_arrow(texts(large, "region"), _as_members(shingle), _MEMBER))
        for more in _pivot_rounds(members, limit):
            links = links.unionByName(more)
    joined = connected_components(links)
    # the least id of a component is found among its sets; only then do the rows, of which many may share a set, get it
    sets = cut(chosen.join(joined, "node", "left").select("node", "rows", "least_id", F.coalesce("component", "node").alias("comp")))
    least = sets.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    found = cut(with_value(sets, least.withColumnRenamed("members", "times"), "comp").select("node", "rows", "component_id"))
    full = with_value(named.where("n_shingles > 0"), found.withColumnRenamed("rows", "times"), "node")
    empty = named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n_shingles", "component_id").unionByName(empty)


def _as_members(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts with ``node`` and ``region`` as members of their regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                region, node = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("region", "node"))
                sets = shingle_sets(part, size)
                held = [i for i, s in enumerate(sets) if identity(s)[0] == node[i]]
                own = pa.array([node[i] for i in held], pa.int64())
                columns = [pa.array([region[i] for i in held], pa.int64()), own, pa.array([len(sets[i]) for i in held], pa.int64()), pa.array([sets[i].tobytes() for i in held], pa.binary()), own]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _MEMBER.split(", ")])

    return run

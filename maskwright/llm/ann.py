"""Approximate nearest neighbours by collision-counting hashing.

Vectors are dealt into shards of bounded size, each sent to one task once; every query visits every shard, in a stream
behind the shard's vectors, so that a task holds one shard and a slice of queries. A shard keeps, for every projection
of a random rotation, its vectors sorted by that projection. A query's window lies around its own projection in each
sorted array and widens level by level (virtual rehashing: only the places that a wider window adds are read). A vector
that falls into half of the windows is verified, by its inner product (the best ones' in double precision); a query stops when its k-th best lies well
within the distance at which half of the windows collide. The last level's windows hold everything, so a shard of few
vectors gives all of them.

Largest inner products become least distances by one more component that gives all vectors the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_rows import in_arrow
from .spark_util import small_side

#: Neighbours of a query; vectors of a shard at most about, and at least where more shards keep more cores busy.
NEAREST, SHARD, LEAST_SHARD = 20, 1 << 15, 1 << 14
#: Vectors beyond the k best whose exact products are taken: short numbers order the verified ones first.
SPARE = 44
#: Queries that are searched together.
BLOCK = 1 << 10
#: Projections; the first window's half width in standard deviations of a projection, and its growth per level: small
#: up to ``NEAR`` deviations, where most queries stop, so that they read no more than they need, and larger beyond.
PROJECTIONS, FIRST, GROWTH, NEAR, FAR_GROWTH = 48, 0.5, 1.12, 2.0, 1.5
#: Share of windows that a vector must fall into. A window of half width w holds a vector at distance s with
#: probability 1/2 if w is QUARTILE * s; a query stops when its k-th best is MARGIN times nearer than that.
SHARE, QUARTILE, MARGIN = 0.5, 0.6745, 1.2


@lru_cache(maxsize=64)
def _rotation(dims: int, seed: int = 7) -> np.ndarray:
    """Orthonormal rows, as many as there are dimensions."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]


class Shard:
    """Sorted projections of vectors of at most length ``longest``."""

    def __init__(self, vectors: np.ndarray, longest: float, projections: int = PROJECTIONS):
        self.vectors, self.short = vectors, (vectors / longest).astype(np.float32)
        norms = (vectors.astype(np.float64) ** 2).sum(1)
        full = np.hstack([vectors, np.sqrt(np.maximum(longest**2 - norms, 0))[:, None]]) / longest
        # as many rotations as give the projections
        turns = -(-projections // full.shape[1])
        self.axes = np.concatenate([_rotation(full.shape[1], 7 + i) for i in range(turns)])[:projections]
        values = self.axes @ full.T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, 1)
        self.longest = longest

    def search(self, queries: np.ndarray, k: int, names: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its ``k`` nearest found places and their inner products, of ties those of the smaller name.

        ``names`` has the vectors' ids and ``own`` the queries'; vectors of a query's own id take no part.
        """
        n, dims = len(self.vectors), self.axes.shape[1]
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        at = np.hstack([unit, np.zeros((len(unit), 1))]) @ self.axes.T
        sigma = 1 / np.sqrt(dims)
        widths = [FIRST * sigma]
        while widths[-1] < 2:
            widths.append(widths[-1] * (GROWTH if widths[-1] < NEAR * sigma else FAR_GROWTH))
        bounds = np.empty((2, len(widths), len(self.axes), len(queries)), np.int32)
        for j, row in enumerate(self.sorted):
            for i, w in enumerate(widths):
                bounds[0, i, j] = np.searchsorted(row, at[:, j] - w, "left")
                bounds[1, i, j] = np.searchsorted(row, at[:, j] + w, "right")
        bounds[0, -1], bounds[1, -1] = 0, n  # the last level holds all
        need, out = int(np.ceil(SHARE * len(self.axes))), []
        vectors, short = self.vectors, unit.astype(np.float32)
        for q in range(len(queries)):
            counts, lows, highs = np.zeros(n, np.int64), bounds[0, :, :, q], bounds[1, :, :, q]
            places, scores = np.zeros(0, np.int64), np.zeros(0, np.float32)
            fresh = np.ones(n, bool)
            fresh[names == own[q]] = False
            was_low = was_high = lows[0].tolist()
            for level, w in enumerate(widths):
                low, high = lows[level].tolist(), highs[level].tolist()
                # what this level's windows add on either side of the last one's
                added = [row[a:c] for row, a, c in zip(self.order, low, was_low, strict=True)]
                added += [row[d:b] for row, d, b in zip(self.order, was_high, high, strict=True)]
                counts += np.bincount(np.concatenate(added), minlength=n)
                was_low, was_high = low, high
                found = np.flatnonzero((counts >= need) & fresh)
                if len(found):
                    fresh[found] = False
                    places = np.append(places, found)
                    scores = np.append(scores, np.einsum("ij,j->i", self.short[found], short[q]))
                    if len(places) > 4 * (k + SPARE):
                        best = np.lexsort((names[places], -scores))[: k + SPARE]
                        places, scores = places[best], scores[best]
                if len(places) >= k:
                    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                    distance = np.sqrt(max(0.0, 2 - 2 * float(kth)))
                    if distance * sigma * MARGIN * QUARTILE <= w:
                        break
            best = places[np.lexsort((names[places], -scores))[: k + SPARE]]
            exact = (vectors[best] * queries[q]).sum(1)
            first = np.lexsort((names[best], -exact))[:k]
            out.append((best[first], exact[first]))
        return out


def _matrix(values: pa.ListArray) -> np.ndarray:
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found by inner product, ties to the smaller id.

    Ids are whole numbers. Vectors that are null, empty, all zero or hold null or non-finite components take no part
    on either side, nor do those with null ids. Vectors of one length are searched by queries of that length; others
    have no inner product with them. A row with a query's own id is no candidate of it; of repeated ids each row
    counts, as candidate and as query. No rows give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    value = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    clean = lambda df: df.where(sound).select(F.col(id_col).alias("vec_id"), value.alias("v"), F.size(vector_col).alias("dims"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    kind = vectors.schema[id_col].dataType.simpleString()
    # shards of each length of vectors: as many as their bound asks for, or as keep all cores busy
    wanted = 4 * spark.sparkContext.defaultParallelism
    parts = F.greatest(F.ceil(F.col("n") / shard), F.least(F.lit(wanted), F.ceil(F.col("n") / min(shard, LEAST_SHARD))))
    sizes = clean(vectors).groupBy("dims").agg(F.count("*").alias("n"), F.max(norm).alias("longest")).select("dims", "longest", parts.cast("long").alias("parts"))
    sizes = small_side(sizes)
    place = F.monotonically_increasing_id()
    cell = F.col("dims") * F.lit(1 << 32) + F.col("part")
    # rows of one id or vector are dealt to many shards
    base = clean(vectors).join(sizes, "dims").withColumn("part", F.pmod(F.xxhash64("vec_id", place), F.col("parts")))
    base = base.select(cell.alias("cell"), F.lit(0).alias("asks"), "vec_id", F.lit(0).cast("long").alias("row"), "v", "longest")
    asked = clean(queries).withColumn("row", place).join(sizes, "dims").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asked = asked.select(cell.alias("cell"), F.lit(1).alias("asks"), "vec_id", "row", "v", "longest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, own = None, [], [], None
        for batch in batches:
            cells, asks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            key = 2 * cells + asks
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)]).tolist()
            for start, stop in zip(starts, [*starts[1:], len(key)], strict=True):
                part = batch.slice(start, stop - start)
                names = part.column(2).to_numpy(zero_copy_only=False)
                if cells[start] != at:
                    at, held, ids, own = cells[start], [], [], None
                if not asks[start]:
                    held.append(_matrix(part.column(4)))
                    ids.append(names)
                    continue
                if own is None and held:
                    own, known = Shard(np.concatenate(held), float(part.column(5)[0].as_py())), np.concatenate(ids)
                    held, ids = [], []
                rows, asked_of = part.column(3).to_numpy(zero_copy_only=False), _matrix(part.column(4))
                for a in range(0, len(names) if own is not None else 0, BLOCK):
                    found = own.search(asked_of[a : a + BLOCK], k, known, names[a : a + BLOCK])
                    counts = [len(places) for places, _ in found]
                    columns = [np.repeat(names[a : a + BLOCK], counts), np.repeat(rows[a : a + BLOCK], counts), known[np.concatenate([p for p, _ in found]).astype(np.int64)], np.concatenate([s for _, s in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (part.schema.field(2).type, pa.int64(), part.schema.field(2).type, pa.float64()), strict=True)], names=["query_id", "row", "vec_id", "score"])

    dealt = base.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "asks")
    near = in_arrow(dealt, run, f"query_id {kind}, row long, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

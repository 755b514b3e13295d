"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges`` (``a``, ``b`` long); the component is its smallest node.

    Each round hooks every node's neighbours to the smallest of them, first the larger ones, then the others, until
    all edges point at the smallest node of their component. Rounds grow with the logarithm of the longest path.
    Loops are left out, so a node of nothing else has no row; repeated edges do no harm; no edges give no rows.
    """
    ends = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    now = cut(edges.where("a != b").select(*ends("a", "b")).distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(low, "a")
        small = hooked.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(hooked.select("a", F.col("m").alias("b"))).select(*ends("a", "b")).where("a != b").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

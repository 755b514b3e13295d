"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every normalised text is cut into blocks of a fixed number of characters. The distinct blocks are sorted
(by hash, then content) and get integer names; adjacent names are paired, the distinct pairs sorted and named
again, and so on until one name is left of each document. Equal names at the same level mean equal texts, with
no chance of a collision: level 0 tells apart blocks of equal hash by their content, and later levels name
pairs of integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import ascii_lower, cut, small_side, with_value

#: Characters in a block.
BLOCK_CHARS = 4096
#: Names are sorted within this many order-preserving ranges, each a window of its own.
RANGES = 1 << 16


def _named(keys: DataFrame, high: Column, order: list[str], weight: Column) -> DataFrame:
    """Distinct ``keys`` with ``name``: their position in sort order (range first), ``weight`` names wide each."""
    in_range = Window.partitionBy("range").orderBy(*order)
    rank = F.sum(weight).over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - weight
    return keys.withColumn("range", high).withColumn("name", F.shiftleft("range", 40) + rank).drop("range")


def _block_names(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Names by block hash, and for hashes that several blocks share, the place of each block among them."""
    distinct = texts.select(F.explode("blocks").alias("block")).select(F.xxhash64("block").alias("h"), "block").groupBy("h", "block").agg(F.count("*").alias("times"))
    counts = cut(distinct.groupBy("h").agg(F.count("*").alias("blocks"), F.sum("times").alias("times")))
    top = F.shiftrightunsigned("h", 48)
    names = _named(counts, top, ["h"], F.col("blocks")).select("h", "name", "times")
    shared = counts.where("blocks > 1").select("h")
    if shared.isEmpty():
        return names, None
    ties = distinct.join(small_side(shared), "h", "left_semi")
    return names, ties.withColumn("tie", F.row_number().over(Window.partitionBy("h").orderBy("block")) - 1)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of a group of equal
    texts the row with the largest id is kept (null ids are the smallest; of repeated rows with that id, one).
    An empty table gives an empty result; columns other than the two named are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    # Generate keeps the optimizer from evaluating the normalised text once for each use
    texts = rows.select("doc_id", F.explode(F.array(ascii_lower(F.col("raw")))).alias("norm"))
    split = F.regexp_extract_all("norm", F.lit(f"(?s)(.{{1,{block_chars}}})"), F.lit(1))
    split = F.when(F.length("norm") == 0, F.array(F.lit(""))).otherwise(split)
    names, ties = _block_names(texts.select(split.alias("blocks")))

    keyed = texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("norm", 256).alias("text_sha256"), split.alias("blocks"))
    if ties is None:
        base = cut(keyed.withColumn("blocks", F.transform("blocks", lambda b: F.struct(F.xxhash64(b).alias("h"), F.lit(0).alias("tie")))))
    else:
        base = cut(_with_ties(keyed, ties))
    blocks = base.select("rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("idx", "b"))
    blocks = with_value(blocks.select("rid", "n", "idx", "b.h", "b.tie"), names, "h")
    blocks = cut(blocks.select("rid", "n", "idx", (F.col("name") + F.col("tie")).alias("name")))
    longest = base.agg(F.max(F.size("blocks"))).first()[0] or 0

    level, done = 0, []
    while True:
        done.append(blocks.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        if (1 << level) >= longest:
            break
        blocks, level = _pair_names(blocks.where("n > 1")), level + 1
        blocks = cut(blocks)  # else each level's plan would hold all the plans before it
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    identity = cut(base.select("rid", "doc_id", "text_sha256").join(identity, "rid"))

    groups = identity.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", (-F.col("rid")).alias("rid"))).alias("keep"))
    found = with_value(identity, groups.withColumn("times", F.col("group_size")), "level", "name")
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == -F.col("keep.rid")).alias("kept"), "text_sha256")


def _pair_names(blocks: DataFrame) -> DataFrame:
    """The next level: neighbours become pairs, pairs get names; a last name without neighbour pairs with -1."""
    odd = F.col("idx") % 2 == 1
    pairs = blocks.groupBy("rid", "n", F.floor(F.col("idx") / 2).cast("int").alias("half")).agg(
        F.max(F.when(~odd, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1).cast("long")).alias("b")
    )
    pairs = cut(pairs)
    names = _named(pairs.groupBy("a", "b").agg(F.count("*").alias("times")), F.shiftrightunsigned(F.xxhash64("a", "b"), 48), ["a", "b"], F.lit(1).cast("long"))
    return with_value(pairs, names, "a", "b").select("rid", F.floor((F.col("n") + 1) / 2).cast("int").alias("n"), F.col("half").alias("idx"), "name")


def _with_ties(keyed: DataFrame, ties: DataFrame) -> DataFrame:
    """Block hashes with the places of blocks that share their hash; those blocks are joined by content."""
    flat = keyed.select("rid", "doc_id", "text_sha256", F.posexplode("blocks").alias("idx", "block")).withColumn("h", F.xxhash64("block"))
    flat = flat.join(small_side(ties), ["h", "block"], "left").withColumn("tie", F.coalesce("tie", F.lit(0)))
    place = F.struct("idx", "h", "tie")
    whole = flat.groupBy("rid", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(place)).alias("places"))
    return whole.select("rid", "doc_id", "text_sha256", F.transform("places", lambda p: F.struct(p["h"].alias("h"), p["tie"].alias("tie"))).alias("blocks"))

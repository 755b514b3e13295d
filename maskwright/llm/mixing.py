"""Mixing of sources to target weights by hierarchical budgets.

A tree of columns (domain, language, source by default) splits a token budget by weights. Each node can hold the
tokens below it times a limit of epochs; what a node cannot hold goes to its siblings by their weights before it
reaches any other branch. A leaf's budget takes whole epochs of the leaf, then a prefix of one more epoch in an order
seeded anew. The prefix's end is found digit by digit over sums of key ranges, so a leaf's rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import cut, small_side

#: Columns of the tree, root's children first; epochs that a leaf may be repeated, at most.
TREE, EPOCHS = ("domain", "lang", "source"), 4
#: Bits of a row's place in an epoch's order, and bits that are settled per step.
KEY_BITS, STEP_BITS = 60, 8
#: Rows of a key range that are summed one by one.
LAST_ROWS = 256


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def seeded_key(id_col: Column, seed: int, epoch: Column) -> Column:
    """A row's place in the order of an epoch: the first 60 bits of an md5 of seed, epoch and id."""
    name = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _weighted(nodes: DataFrame, level: int, weights: DataFrame | None) -> DataFrame:
    """``nodes`` with their target weight among siblings: as given for level and name, else 1."""
    if weights is None:
        return nodes.withColumn("weight", F.lit(1.0))
    own = weights.where(F.col("level") == level).select(F.col("name").alias(f"mix_{level}"), F.col("weight").cast("double")).dropDuplicates([f"mix_{level}"])
    return nodes.join(small_side(own), f"mix_{level}", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)))


def budgets(leaves: DataFrame, depth: int, total: Column | float, weights: DataFrame | None = None, epochs: int = EPOCHS) -> DataFrame:
    """``leaves`` (``mix_0 ..`` and ``tokens``) with ``budget``, whole tokens of a total split from the root down.

    Among siblings the budget rises in proportion to weight until the lowest can hold no more; the others go on.
    Nodes of weight 0 get nothing.
    """
    names = [f"mix_{i}" for i in range(depth)]
    above = leaves.select(F.lit(0).alias("root"), "tokens").groupBy("root").agg((F.sum("tokens") * epochs).cast("double").alias("cap"))
    whole = above.select(F.least("cap", F.lit(total).cast("double") if not isinstance(total, Column) else total.cast("double")).alias("share")).first()
    root = F.lit(whole[0] if whole else 0.0).cast("double")
    for i in range(depth):
        nodes = leaves.groupBy(*names[: i + 1]).agg((F.sum("tokens") * epochs).cast("double").alias("cap"))
        nodes = _weighted(nodes, i, weights).where("weight > 0 AND cap > 0")
        nodes = nodes.join(small_side(above), names[:i]) if i else nodes.withColumn("share", root)
        fill = Window.partitionBy(*(names[:i] or [F.lit(0)])).orderBy(F.col("cap") / F.col("weight"), names[i])
        before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
        # water level at which the nodes from here on share what those before, all full, leave
        nodes = nodes.withColumn("rise", (F.col("share") - before) / left)
        nodes = nodes.withColumn("full", F.col("cap") <= F.col("weight") * F.col("rise"))
        stop = F.max(F.when(~F.col("full"), F.col("rise"))).over(Window.partitionBy(*(names[:i] or [F.lit(0)])))
        above = nodes.select(*names[: i + 1], F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.coalesce(stop, F.lit(0.0)))).alias("share"))
    # a millionth of a token, lest rounding takes a whole one
    return leaves.join(small_side(above), names, "left").select(*names, "tokens", F.floor(F.coalesce("share", F.lit(0.0)) + 1e-6).cast("long").alias("budget"))


def _prefix_ends(rows: DataFrame, names: list[str]) -> DataFrame:
    """For each leaf the last ``key, tie`` of its prefix: running tokens up to ``rest`` (rows of equal key and tie together)."""
    whole, now, shift = [], rows, KEY_BITS
    while True:
        heads = now.groupBy(*names).agg(F.count("*").alias("n"))
        if shift <= 0 or not heads.where(F.col("n") > LAST_ROWS).limit(1).count():
            break
        shift -= STEP_BITS
        cell = F.shiftright("key", max(shift, 0)).alias("cell")
        sums = now.groupBy(*names, cell).agg(F.sum("tokens").alias("t"), F.max("rest").alias("rest"), F.max(F.struct("key", "tie")).alias("end"))
        running = F.sum("t").over(Window.partitionBy(*names).orderBy("cell"))
        sums = cut(sums.withColumn("upto", running))
        held = F.col("upto") <= F.col("rest")
        whole.append(sums.where(held).groupBy(*names).agg(F.max("end").alias("end")))
        edge = sums.where(~held).groupBy(*names).agg(F.min_by(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("t")).alias("rest")), "cell").alias("edge"))
        edge = small_side(edge.select(*names, F.col("edge.cell").alias("cell"), F.col("edge.rest").alias("rest")))
        now = cut(now.drop("rest").withColumn("cell", F.shiftright("key", max(shift, 0))).join(edge, [*names, "cell"]).drop("cell"))
    running = F.sum("tokens").over(Window.partitionBy(*names).orderBy("key", "tie"))  # a range frame: peers count together
    last = now.withColumn("upto", running).where("upto <= rest").groupBy(*names).agg(F.max(F.struct("key", "tie")).alias("end"))
    for more in whole:
        last = last.unionByName(more)
    return last.groupBy(*names).agg(F.max("end").alias("end"))


def mix_sources(docs: DataFrame, share: float = 1.0, weights: DataFrame | None = None, tree: tuple[str, ...] = TREE, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS, seed: int = 1, report: bool = False) -> DataFrame:
    """``docs`` with ``copies``: how many times a row enters the mixture (0: not at all).

    The total budget is ``share`` times all tokens (``tokens``; words of the text unless given), at most ``epochs``
    times what there is. ``weights`` has ``level, name, weight`` for nodes of ``tree``'s columns; others weigh 1.
    Null names are leaves of their own, weighed by the empty name. Null texts have no tokens. Rows equal in id and
    text enter together. A column named ``copies`` is replaced; other columns stay. No rows give no rows. With
    ``report``, the leaves' names, ``tokens`` and ``budget`` instead.
    """
    names = [f"mix_{i}" for i in range(len(tree))]
    at = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(tree, names, strict=True)]
    count = F.coalesce(tokens if tokens is not None else word_count(F.col(text_col)), F.lit(0)).cast("long")
    tie = F.xxhash64(id_col, text_col)
    rows = cut(docs.select(*at, F.col(id_col).alias("id"), count.alias("tokens"), tie.alias("tie")))
    leaves = cut(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    total = share * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    plan = budgets(leaves, len(tree), total, weights, epochs)
    if report:
        return plan.select(*(F.col(n).alias(c) for n, c in zip(names, tree, strict=True)), "tokens", "budget")
    plan = plan.select(*names, F.floor(F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(0)).cast("int").alias("whole"), "tokens", "budget")
    plan = small_side(plan.select(*names, "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("rest")))
    keyed = rows.join(plan, names).where("rest > 0").select(*names, seeded_key(F.col("id"), seed, F.col("whole")).alias("key"), "tie", "tokens", "rest")
    ends = _prefix_ends(cut(keyed), names)
    plan = small_side(plan.join(ends, names, "left").select(F.struct(*names).alias("mix_leaf"), F.col("whole").alias("mix_whole"), F.col("end.key").alias("mix_key"), F.col("end.tie").alias("mix_tie")))
    own = docs.withColumns({"mix_leaf": F.struct(*at), "mix_own": F.xxhash64(id_col, text_col)}).join(plan, "mix_leaf")
    key = seeded_key(F.col(id_col), seed, F.col("mix_whole"))
    before = (key < F.col("mix_key")) | ((key == F.col("mix_key")) & (F.col("mix_own") <= F.col("mix_tie")))
    out = own.withColumn("copies", F.col("mix_whole") + F.coalesce(before.cast("int"), F.lit(0)))
    return out.select(*(c for c in docs.columns if c != "copies"), "copies")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says, without that column."""
    return mixed.where("copies > 0").withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")

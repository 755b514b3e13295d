"""Prefix tries of conversations, built and summed up level by level.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Going down, each
round groups the live conversations of one depth by (node, next turn) and names each group by its smallest member. A
conversation is live while it shares its node with another: one that is alone forms a chain, whose nodes are all known
without a round of their own. Going up, each round joins one depth's nodes to the sums of their children. There are as
many rounds as the deepest shared node has turns. Texts are read once; rounds carry digests of turns.

Tables between rounds lie in the shared folder, one subfolder for each depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow_rows import in_arrow
from .spark_util import HOT_SHARE, cut, stage_folder, with_value

#: Digest of no text, and members whose decimal ids are joined into one row before they are hashed.
NOTHING, IDS_A_ROW = hashlib.sha256(b"").hexdigest(), 1 << 14


def number_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, turn_key, n_bytes``: each conversation's turns from 1 on, a digest of (role, text), bytes of text.

    Turns are in the order of their number, null first, equal ones by digest. Null roles and texts are empty; rows
    without a conversation are left out. Rows are sorted over ranges, so that a conversation may span many tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), key.alias("turn_key"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "turn_key", "rid"]
    slim = slim.withColumn("rid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn_key", "n_bytes")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held, opener = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            at = np.arange(len(ids))
            new = np.append(ids[0] != last, ids[1:] != ids[:-1])
            pos = at - np.maximum.accumulate(np.where(new, at, -held)) + 1
            opener = ids[0] if last is None else opener
            last, held = ids[-1], int(pos[-1])
            columns = [batch.column(0), pa.array(np.full(len(ids), part)), pa.array(pos), pa.array(ids == opener), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "pos", "opening", "turn_key", "n_bytes"])

    placed = cut(in_arrow(slim, number, "conv_id long, part long, pos long, opening boolean, turn_key binary, n_bytes long"))
    # only a partition's first conversation can have begun in an earlier one: as many rows as partitions, at most
    opened = placed.where("opening").groupBy("part").agg(F.min("conv_id").alias("conv_id"))
    counts = placed.join(F.broadcast(opened.select("conv_id").distinct()), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.sum("n").over(earlier)).where("before IS NOT NULL").select("conv_id", "part", "before")
    return placed.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "turn_key", "n_bytes")


def sizes(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of numbered turns."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))


def forked(turns: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and sizes of conversations that are rebuilt as forks of others.

    Of every conversation c, the first h turns become those of conversation c - c % ``family`` (all if it has fewer, none
    if it is absent); its own turns after its first h follow. h is the unsigned crc32 of c in decimal, modulo ``most`` + 1.
    """
    own = cut(sizes(turns).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).withColumn("base", F.col("conv_id") - F.col("conv_id") % family))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    given = F.least("h", F.coalesce("base_turns", F.lit(0)))
    plan = cut(own.join(bases, "base", "left").select("conv_id", "base", "h", given.alias("given"), (given + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"), F.col("n_turns").alias("times")))
    # of a base at most ``most`` turns meet at most ``family`` forks
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base")
    taken = heads.join(plan.select("conv_id", "base", "h"), "base").where(F.col("pos") <= F.col("h"))
    rest = with_value(turns, plan.select("conv_id", "h", "given", "times"), "conv_id").where(F.col("pos") > F.col("h"))
    rest = rest.withColumn("pos", F.col("pos") - F.col("h") + F.col("given"))
    columns = ["conv_id", "pos", "turn_key", "n_bytes"]
    return taken.select(columns).unionByName(rest.select(columns)), plan.select("conv_id", "n_turns")


def _next(live: DataFrame, turns: DataFrame, depth: int) -> DataFrame:
    """Live conversations of one depth with their next turn (nulls where they end)."""
    ahead = turns.where(F.col("pos") == depth + 1).select("conv_id", "turn_key", "n_bytes")
    return live.join(ahead, "conv_id", "left")


def _assigned(step: DataFrame, shared: DataFrame) -> DataFrame:
    """Conversations of ``step`` that go on to a shared node, with that node.

    Nodes of many members are broadcast (there are at most ``HOT_SHARE``), the others joined by a shuffle in which no
    key has more than a small share.
    """
    on = ["node", "turn_key"]
    total = shared.agg(F.sum("times")).first()[0] or 0
    hot = F.col("times") > total / HOT_SHARE
    often = F.broadcast(shared.where(hot).select(*on, "child"))
    rest = step.join(F.broadcast(shared.where(hot).select(on)), on, "left_anti").join(shared.where(~hot).select(*on, "child"), on)
    return step.join(often, on).unionByName(rest).select("conv_id", F.col("child").alias("node"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """``node, depth, ends_sha256`` of rows ``node, depth, conv_id``: members in ascending order, as decimals with commas.

    Members are sorted over ranges and joined into rows of a bounded size, which are hashed in order as they stream by.
    """
    order = ["depth", "node", "conv_id"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, node, ids = (c.to_numpy() for c in batch.columns)
            opens = np.append(True, (depth[1:] != depth[:-1]) | (node[1:] != node[:-1]))
            cuts = np.union1d(np.flatnonzero(opens), np.arange(0, len(ids), IDS_A_ROW))
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(depth[cuts]), pa.array(node[cuts]), pa.array(ids[cuts]), pa.array(texts, pa.string())], names=["depth", "node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for depth, node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (depth, node) == at:
                    state.update(b",")
                else:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (depth, node), hashlib.sha256()
                state.update(ids.encode())
            yield _rows(done)
        if at is not None:
            yield _rows([(*at, state.hexdigest())])

    packed = in_arrow(ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order), joined, "depth long, node long, first long, ids string")
    return in_arrow(packed.repartition("depth", "node").sortWithinPartitions("depth", "node", "first"), digest, "depth long, node long, ends_sha256 string")


def _rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, node, sha = zip(*done, strict=True) if done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(sha, pa.string())], names=["depth", "node", "ends_sha256"])


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (``conv_id, pos, turn_key, n_bytes``, from 1 on without gaps) of all
    ``conversations`` (``conv_id, n_turns``; those without turns are members of the root).

    One row per node: ``conv_id`` (smallest member) and ``depth`` name it, ``parent_conv_id`` is its parent's conv_id
    (null at the root, depth 0), ``turn_key`` its last turn's; ``n_convs``, ``n_children``, ``n_leaves`` (childless
    nodes in its subtree, itself included), ``saved_bytes`` (over its subtree, what members but one repeat of each
    node's last text), ``ends_sha256`` (of the members that end here). Without conversations there are no nodes.
    """
    spark, folder = turns.sparkSession, stage_folder(turns.sparkSession)

    def put(df: DataFrame, kind: str, depth: int) -> DataFrame:
        path = f"{folder}/{kind}/depth={depth}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    # rows of one place lie together in each file, and a round reads only their pages
    turns = cut(turns.sortWithinPartitions("pos"))
    conversations = cut(conversations)
    n, smallest = conversations.agg(F.count("*"), F.min("conv_id")).first()
    root = conversations.groupBy().agg(F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("binary").alias("turn_key"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("n_bytes")).where("conv_id IS NOT NULL")
    nodes, groups, depth = [root], [], 0
    live = conversations.select("conv_id", F.lit(smallest).cast("long").alias("node"))
    while True:
        step = put(_next(live, turns, depth), "live", depth)
        grouped = step.where(F.col("turn_key").isNotNull()).groupBy("node", "turn_key").agg(F.min("conv_id").alias("child"), F.count("*").alias("times"), F.max("n_bytes").alias("n_bytes"))
        grouped = put(grouped, "groups", depth + 1)
        groups.append(grouped)
        shared = grouped.where("times > 1")
        if shared.isEmpty():
            break
        nodes.append(shared.select(F.col("child").alias("conv_id"), F.col("node").alias("parent"), "turn_key", F.col("times").alias("n_convs"), "n_bytes"))
        live, depth = _assigned(step, shared), depth + 1
    below = None
    for d in range(depth, -1, -1):
        sums = groups[d].where("times = 1").groupBy("node").agg(F.count("*").alias("children"), F.count("*").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        if below is not None:
            sums = sums.unionByName(below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_bytes").alias("saved")))
            sums = sums.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
        summed = nodes[d].join(sums.withColumnRenamed("node", "conv_id"), "conv_id", "left")
        saved = F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("n_bytes")
        below = put(summed.select("conv_id", "parent", "turn_key", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_bytes")), "nodes", d)

    def whole(kind: str, like: DataFrame) -> DataFrame:
        return spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in like.schema)}, depth long").parquet(f"{folder}/{kind}")

    ends = _end_digests(whole("live", step).where("turn_key IS NULL").select("node", "depth", "conv_id"))
    shared = whole("nodes", below).join(ends.withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
    shared = shared.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "turn_key", "n_convs", "n_children", "n_leaves", "saved_bytes", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    alone = whole("groups", grouped).where("times = 1").select(F.col("child").alias("conv_id"), F.col("depth").alias("fork"), "node")
    alone = alone.join(conversations, "conv_id").withColumn("times", F.col("n_turns") - F.col("fork") + 1)
    chains = with_value(turns, alone, "conv_id").where(F.col("pos") >= F.col("fork"))
    last = F.col("pos") == F.col("n_turns")
    chains = chains.select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("fork"), F.col("node")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "turn_key", F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_bytes"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    return shared.unionByName(chains)

"""Reply-ordered conversations from the passages that messages quote.

Lines are parsed into levels by their leading ``>`` marks, outside of code fences. A message's passages (its own part,
paragraphs and lines, and its lines as they stand) and the quoted passages (with one mark taken off, and deeper levels
as their first author wrote them) are hashed in normal form. One row per conversation and hash names the earliest
message that wrote a passage, so joining quotes to originals never multiplies rows. Quoted lines that are linked to an
earlier message leave the text, as do quotations that a line of mail announces; all else stays: tables, prompts, code,
quotes of nobody. A message replies to the message of its longest linked passage (the outermost level first), or else
to the message before it. Replies are ordered depth first: runs of messages without a link of their own are nodes of a
tree, whose tour is ranked by pointer doubling.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrow_rows import in_arrow, slices
from .spark_util import cut

#: Quote marks at the start of a line, and the fences of code.
MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
FENCE = re.compile(r"[ \t]{0,3}(```|~~~)")
#: Lines of mail that announce a quotation: by a date, or by an address.
ANNOUNCED = re.compile(r"(?i)\s*(?:(?:on|am|le|el)\b(?=.{0,200}\d).{0,200}|.{0,200}[\w.+-]@[\w-]+\.\w.{0,100})\b(?:wrote|schrieb|a écrit|escribió)\b.{0,100}:\s*")
#: A line before a linked quotation that names its author.
CREDIT = re.compile(r"(?i)\s*(?:on\b.{0,200}\bwrote|.{0,200}\b(?:wrote|said|schrieb|a écrit|escribió))\s*:\s*")

_READ = "conv_id long, turn long, role string, text string, rid long"
_PARSED = f"{_READ}, n_quotes int, passages array<long>, quotes array<struct<level:int,size:int,hash:long>>"


def normal_form(lines: list[str]) -> str:
    """Lower case, white space as single spaces, quote marks closed up."""
    kept = []
    for line in lines:
        m = MARKS.match(line)
        kept.append(f"{'>' * m[1].count('>')} {line[m.end() :]}" if m else line)
    return " ".join(" ".join(kept).lower().split())


def levels(text: str) -> list[tuple[int, str]]:
    """The lines of ``text`` with their quote levels; within a code fence every line is of level 0."""
    out, fenced = [], None
    for line in text.split("\n"):
        fence = FENCE.match(line)
        if fence and fenced in (None, fence[1]):
            fenced = None if fenced else fence[1]
        m = None if fence or fenced else MARKS.match(line)
        out.append((m[1].count(">") if m else 0, line))
    return out


def _unmarked(line: str, times: int) -> str:
    """``line`` without its first ``times`` marks."""
    for _ in range(times):
        line = re.sub(r"^[ \t]{0,3}>[ \t]?", "", line, count=1)
    return line


def parse_levels(text: str) -> list[tuple[int, list[str]]]:
    """Runs of lines of one quote level without their marks, in order; level 0 is the message's own text."""
    runs: list[tuple[int, list[str]]] = []
    for level, line in levels(text):
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(_unmarked(line, level))
    return runs


def passages(lines: list[str]) -> dict[str, int]:
    """Normal forms of the whole, its paragraphs and its lines, with their lengths."""
    whole = normal_form(lines)
    found = {whole: len(whole)} if whole else {}
    paragraph: list[str] = []
    for line in [*lines, ""]:
        one = normal_form([line])
        if one:
            paragraph.append(line)
            found[one] = len(one)
        elif paragraph:
            one = normal_form(paragraph)
            found[one] = len(one)
            paragraph = []
    return found


def _digest(passage: str) -> int:
    return xxhash.xxh64_intdigest(passage.encode("utf-8", "surrogatepass")) - (1 << 63)


def _blocks(lines: list[tuple[int, str]]) -> list[range]:
    """Ranges of lines next to each other that are quoted, at whatever level."""
    out: list[range] = []
    for i, (level, _) in enumerate(lines):
        if level:
            out = [*out[:-1], range(out[-1].start, i + 1)] if out and out[-1].stop == i else [*out, range(i, i + 1)]
    return out


def _parse(text: str) -> tuple[int, list[int], list[dict]]:
    """How many runs of quoted lines of one level ``text`` has, the hashes of its passages, and those that it quotes."""
    lines = levels(text)
    own = passages([line for level, line in lines if not level]) | {normal_form([line]): 0 for level, line in lines if level}
    quotes: dict[int, tuple[int, int]] = {}

    def quoted(level: int, said: list[str]) -> None:
        for passage, size in passages(said).items():
            key = _digest(passage)
            quotes[key] = min(quotes.get(key, (level, -size)), (level, -size))

    n = sum(1 for i, (level, _) in enumerate(lines) if level and (not i or lines[i - 1][0] != level))
    for block in _blocks(lines):
        quoted(1, [_unmarked(lines[i][1], 1) for i in block])
        deeper: list[int] = []
        for i in [*block, block.stop]:
            level = lines[i][0] if i in block else 0
            if deeper and level != lines[deeper[0]][0]:
                quoted(lines[deeper[0]][0], [_unmarked(lines[j][1], lines[j][0]) for j in deeper])
                deeper = []
            if level > 1:
                deeper.append(i)
    return n, [_digest(p) for p in own if p], [{"level": a, "size": -b, "hash": h} for h, (a, b) in quotes.items()]


def without_quotes(text: str, linked: set[int]) -> str:
    """``text`` without the quoted lines whose passages are in ``linked``, and without announced quotations."""
    lines = levels(text)
    gone: set[int] = set()
    for block in _blocks(lines):
        before = next((i for i in range(block.start - 1, -1, -1) if lines[i][1].strip()), None)
        if before is not None and not lines[before][0] and ANNOUNCED.fullmatch(lines[before][1]):
            gone.update([before, *block])
            continue
        said = {i: _unmarked(lines[i][1], 1) for i in block}
        if _digest(normal_form(list(said.values()))) in linked:
            gone.update(block)
        paragraph: list[int] = []
        for i in [*block, block.stop]:
            if i in said and normal_form([said[i]]):
                paragraph.append(i)
                if _digest(normal_form([said[i]])) in linked:
                    gone.add(i)
                continue
            if paragraph and _digest(normal_form([said[j] for j in paragraph])) in linked:
                gone.update(paragraph)
            if i in said and paragraph and set(paragraph) <= gone:
                gone.add(i)  # a blank line goes with the paragraph before it
            paragraph = []
        if before is not None and set(block) <= gone and CREDIT.fullmatch(lines[before][1]):
            gone.add(before)
    if not gone:
        return text
    return "\n".join(line for i, (_, line) in enumerate(lines) if i not in gone).strip()


def _order(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``conv_id, turn, explicit``) with ``place`` in the conversation, and place and turn of the last node so
    far that is explicit or first. Nodes are dealt in ranges of order, so a long conversation is spread over tasks."""
    parts = nodes.sparkSession.sparkContext.defaultParallelism * 4
    rows = cut(nodes.repartitionByRange(parts, "conv_id", "turn").withColumn("bucket", F.spark_partition_id()))
    inside = Window.partitionBy("conv_id", "bucket").orderBy("turn")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.row_number().over(inside) - 1)
    rows = rows.withColumn("head", F.last(F.when(F.col("explicit").isNotNull(), F.struct("nth", "turn")), True).over(upto)).withColumn("prior", F.lag("turn").over(inside))
    rows = cut(rows)
    sums = rows.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"), F.min("turn").alias("least"), F.max("turn").alias("most"), F.max("head").alias("head"))
    over = Window.partitionBy("conv_id").orderBy("bucket")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(past), F.lit(0))).withColumn("prior", F.lag("most").over(over)).withColumn("first", F.min("least").over(over))
    sums = sums.withColumn("at", F.when(F.col("head").isNotNull(), F.struct((F.col("before") + F.col("head.nth")).alias("place"), F.col("head.turn").alias("turn"))))
    sums = sums.withColumn("carried", F.last("at", True).over(past))
    sums = sums.select("conv_id", "bucket", "before", F.col("prior").alias("far"), "first", "carried")
    both = rows.join(sums, ["conv_id", "bucket"])
    own = F.when(F.col("head").isNotNull(), F.struct((F.col("before") + F.col("head.nth")).alias("place"), F.col("head.turn").alias("turn")))
    start = F.struct(F.lit(0).cast("long").alias("place"), F.col("first").alias("turn"))
    return both.select("conv_id", "turn", "explicit", (F.col("before") + F.col("nth")).alias("place"), F.coalesce("prior", "far").alias("prior"), F.coalesce(own, F.col("carried"), start).alias("head"))


def _positions(placed: DataFrame) -> DataFrame:
    """``conv_id, head_turn, at``: where each run of messages begins in the depth-first order of its conversation.

    A run's tour is its messages, then the tours of the runs that hang on it: those on later messages first, as a reply
    comes after all that its message's next one started, then by turn. Only conversations with links are toured.
    """
    runs = placed.groupBy("conv_id", F.col("head.turn").alias("v")).agg(F.count("*").alias("n"), F.max(F.when(F.col("turn") == F.col("head.turn"), F.col("explicit"))).alias("up"))
    hangs = placed.select("conv_id", F.col("turn").alias("up"), F.col("head.turn").alias("parent"), F.col("place").alias("on"))
    runs = runs.join(hangs, ["conv_id", "up"], "left").select("conv_id", "v", "n", "parent", "on")
    linked = runs.where("parent IS NOT NULL").select("conv_id").distinct()
    runs = cut(runs.join(linked, "conv_id", "left_semi"))
    children = Window.partitionBy("conv_id", "parent").orderBy(F.desc("on"), "v")
    beside = runs.where("parent IS NOT NULL").withColumn("next", F.lead("v").over(children)).withColumn("nth", F.row_number().over(children))
    first = beside.where("nth = 1").select("conv_id", F.col("parent").alias("v"), F.col("v").alias("child"))
    # an arc into each run and one out of it; each names the arc after it, and weighs what it passes
    arc = lambda v, out: F.struct(v.alias("v"), F.lit(out).alias("out"))
    inward = runs.join(first, ["conv_id", "v"], "left").select(
        "conv_id", arc(F.col("v"), False).alias("arc"), F.when(F.col("child").isNull(), arc(F.col("v"), True)).otherwise(arc(F.col("child"), False)).alias("next"), F.col("n").alias("sum")
    )
    after = F.when(F.col("next").isNotNull(), arc(F.col("next"), False)).otherwise(arc(F.col("parent"), True))
    outward = beside.select("conv_id", arc(F.col("v"), True).alias("arc"), after.alias("next"), F.lit(0).cast("long").alias("sum"))
    ends = runs.where("parent IS NULL").select("conv_id", arc(F.col("v"), True).alias("arc"), F.lit(None).cast("struct<v:bigint,out:boolean>").alias("next"), F.lit(0).cast("long").alias("sum"))
    now = cut(inward.unionByName(outward).unionByName(ends))
    while now.where("next IS NOT NULL").limit(1).count():
        further = now.select("conv_id", F.col("arc").alias("next"), F.col("next").alias("then"), F.col("sum").alias("more"))
        joined = now.join(further, ["conv_id", "next"], "left")
        now = cut(joined.select("conv_id", "arc", F.col("then").alias("next"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum")))
    totals = runs.groupBy("conv_id").agg(F.sum("n").alias("total"))
    return now.where("NOT arc.out").join(totals, "conv_id").select("conv_id", F.col("arc.v").alias("head_turn"), (F.col("total") - F.col("sum")).alias("at"))


def _threads(nodes: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, thread, depth, position`` for nodes whose explicit parent, if any, is an earlier turn."""
    placed = cut(_order(nodes))
    heads = placed.where("explicit IS NOT NULL").select("conv_id", F.col("turn").alias("at"), F.col("explicit").alias("p"))
    to = placed.select("conv_id", F.col("turn").alias("p"), F.col("head.turn").alias("up"), (F.col("place") - F.col("head.place") + 1).alias("steps"))
    now = cut(heads.join(to, ["conv_id", "p"]).select("conv_id", "at", "up", "steps"))
    none = now.isEmpty()
    while not none:  # each round doubles the stretch from a run of messages to the one it hangs on
        further = now.select("conv_id", F.col("at").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        joined = now.join(further, ["conv_id", "up"], "left")
        if joined.where("next IS NOT NULL").limit(1).count() == 0:
            break
        now = cut(joined.select("conv_id", "at", F.coalesce("next", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    hung = now.select("conv_id", F.col("at").alias("head_turn"), F.col("up").alias("top"), "steps")
    out = placed.withColumn("head_turn", F.col("head.turn")).join(hung, ["conv_id", "head_turn"], "left")
    depth = F.col("place") - F.col("head.place") + F.coalesce("steps", F.lit(0))
    position = F.col("place")
    if not none:
        out = out.join(_positions(placed), ["conv_id", "head_turn"], "left")
        position = F.coalesce(F.col("at") + F.col("place") - F.col("head.place"), position)
    return out.select("conv_id", "turn", F.coalesce("explicit", "prior").alias("reply_to"), F.coalesce("top", "head_turn").alias("thread"), depth.alias("depth"), position.alias("position"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: ``conv_id, turn, role, text`` without linked quotes, ``reply_to`` (a turn), ``thread`` (its
    first turn), ``depth``, ``position``, ``n_quotes`` (runs of quoted lines of one level), ``linked_quotes`` (passages that are linked).

    Ordered by ``position`` a conversation reads depth first, each message after the one it answers; ``depth`` counts
    replies from the thread's first message. Rows of the same turn are one message in links and reply to the same
    turn. Null texts are empty. Null conversations form one, null turns come first (both as the least long). Quotes of
    no earlier message stay in the text unless a line of mail announces them. A text without quotes stays as it is,
    one that loses some also loses white space at its ends. No rows give no rows; other columns are ignored.
    """
    low = F.lit(-(1 << 62)).cast("long")
    rows = messages.select(F.coalesce(F.col(conv_col).cast("long"), low).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), low).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    schema = to_arrow_schema(StructType.fromDDL(_PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                parsed = [_parse(t) for t in part.column(3).to_pylist()]
                made = [pa.array([p[k] for p in parsed], schema.types[5 + k]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], schema=schema)

    parsed = cut(in_arrow(rows, run, _PARSED))
    asked = parsed.select("conv_id", "turn", "rid", F.explode("quotes").alias("q")).select("conv_id", "turn", "rid", "q.level", "q.size", "q.hash")
    # only passages that somebody quotes need their first message
    wanted = asked.select("conv_id", "hash").distinct()
    wrote = parsed.select("conv_id", F.explode("passages").alias("hash"), "turn").join(wanted, ["conv_id", "hash"], "left_semi")
    wrote = wrote.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    linked = cut(asked.join(wrote, ["conv_id", "hash"]).where("origin < turn"))
    best = linked.groupBy("conv_id", "turn").agg(F.min_by("origin", F.struct("level", -F.col("size"), "origin")).alias("explicit"))
    per_row = linked.groupBy("rid").agg(F.collect_list(F.when(F.col("level") == 1, F.col("hash"))).alias("hashes"), F.count("*").alias("linked_quotes"))
    nodes = parsed.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).drop("n").join(best, ["conv_id", "turn"], "left")
    # all that is known of a message, narrow, before it meets the text
    known = parsed.select("rid", "conv_id", "turn").join(_threads(nodes), ["conv_id", "turn"]).join(per_row, "rid", "left").drop("conv_id", "turn")
    both = parsed.drop("passages", "quotes").join(known, "rid")
    back = lambda c: F.when(F.col(c) != low, F.col(c)).alias(c)
    out = both.select(back("conv_id"), back("turn"), "role", "text", back("reply_to"), back("thread"), "depth", "position", "n_quotes", F.coalesce("linked_quotes", F.lit(0)).cast("int").alias("linked_quotes"), "hashes")
    kind = StructType([f for f in out.schema.fields if f.name != "hashes"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, hashes, n = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "hashes", "n_quotes"))
            kept = pa.array([without_quotes(t, set(h or ())) if k else t for t, h, k in zip(texts, hashes, n, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([kept if i == at else batch.column(i) for i in range(len(kind.fields))], schema=to_arrow_schema(kind))

    return in_arrow(out, strip, kind)

"""Texts and screen lines as ordered lines and units."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import vocab as V
from ..cluster import ship
from ..functions.geometry import BOX, on_one_line, outside, shared_height, union

#: Characters that phrases do not have.
_DROPPED = frozenset(V.SPACES + ":：;；,，.。、()（）[]「」【】")
_WORDS = lambda line: F.regexp_extract_all(line, F.lit("([^ \\t\\r\\x0B\\f]+)"), F.lit(1))

#: A morpheme; ``word_position`` is its first character in the line, from 1.
TOKEN = "struct<surface_form: string, pos: string, pos_detail_1: string, pos_detail_2: string, word_type: string, word_position: int>"
SYMBOLS = f"array<struct<text: string, bbox: {BOX}>>"
WORDS = f"array<struct<text: string, confidence: double, bbox: {BOX}, symbols: {SYMBOLS}>>"


def lines_of(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``id, block_id, line`` for each line; null texts have none."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("block_id", "line"))


def units_of(lines: DataFrame) -> DataFrame:
    """``id, block_id, unit_idx, text``: runs of other than white space. White space counts in ``unit_idx``, so none are adjacent."""
    words = lines.select("id", "block_id", F.posexplode(_WORDS("line")).alias("n", "text"))
    return words.select("id", "block_id", (2 * F.col("n")).alias("unit_idx"), "text")


def spaced_blocks(lines: DataFrame) -> DataFrame:
    """``id, block_id, units``: the words of a line with white space as a unit after each, so a word's place is its ``unit_idx``."""
    return lines.select("id", "block_id", F.flatten(F.transform(_WORDS("line"), lambda w: F.array(w, F.lit(" ")))).alias("units")).where(F.size("units") > 0)


def word_blocks(lines: DataFrame) -> DataFrame:
    """``id, block_id, units``: the words of a line side by side, as labels read from a picture are."""
    return lines.select("id", "block_id", _WORDS("line").alias("units")).where(F.size("units") > 0)


#: Characters of a line that stay together; longer lines are cut.
PIECE_CHARS = 1 << 18
#: Characters of pieces that a task holds before it passes them on.
HELD_CHARS = 1 << 20
_CUT = re.compile("[ \\t\\r\\x0b\\f]+")


def _beyond(line: str, at: int, step: int, reach: int) -> int:
    """The place from which ``reach`` characters that phrases are made of lie between it and ``at``, going by ``step``."""
    while reach > 0 and 0 <= (at if step > 0 else at - 1) < len(line):
        reach -= line[at if step > 0 else at - 1] not in _DROPPED
        at += step
    return at


def pieces_of(line: str, limit: int = PIECE_CHARS, reach: int = 0) -> Iterator[tuple[str, int, int, int]]:
    """A line in pieces of about ``limit`` characters: text, words at its beginning and at its end that are those of the
    neighbours, and words of the line before its own.

    Lines are cut at white space, which no pattern crosses. Phrases do: so a piece is given with as much of its
    neighbours as has ``reach`` characters of phrases, up to the next white space.
    """
    start, before = 0, 0
    while True:
        cut = _CUT.search(line, start + limit)
        end = cut.start() if cut else len(line)
        low, high = _beyond(line, start, -1, reach), _beyond(line, end, 1, reach)
        while low > 0 and not _CUT.match(line, low - 1):
            low -= 1
        more = _CUT.search(line, high)
        high = (more.start() if more else len(line)) if high > end else end
        own = len(_words_in(line[start:end]))
        yield line[low:high], len(_words_in(line[low:start])), len(_words_in(line[end:high])), before
        before += own
        if cut is None:
            return
        start = end


def _words_in(text: str) -> list[str]:
    return [w for w in _CUT.split(text) if w]


def long_lines(lines: DataFrame, reach: int = 0, limit: int = PIECE_CHARS) -> DataFrame:
    """Lines of any length in pieces: ``id, block_id, skip, size, first, line``.

    A long line becomes several rows, dealt to all tasks. Of the units of a row's words and the white space behind each,
    those from ``skip`` on, ``size`` of them, are its own; the others are neighbours' and only let phrases reach over the
    cut. ``first`` is the ``unit_idx`` of the first own one. ``reach`` is the length of the longest phrase. A word is never cut.
    """
    ship(lines.sparkSession)
    own = lines.select("id", "block_id", "line")
    short = own.where(F.length("line") <= limit)
    # a short line is all its own
    short = short.select("id", "block_id", F.lit(0).alias("skip"), F.lit((1 << 31) - 1).alias("size"), F.lit(0).alias("first"), "line")
    long = own.where(F.length("line") > limit)
    kind = StructType([*long.select("id", "block_id").schema.fields, *StructType.fromDDL("skip int, size int, first int, line string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)

        def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            of, *values = zip(*rows, strict=True)
            columns = [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), *map(pa.array, values)]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        for batch in batches:
            rows, chars = [], 0
            for i in range(batch.num_rows):
                for text, skip, tail, first in pieces_of(batch.column(2)[i].as_py(), limit, reach):
                    size = len(_words_in(text)) - skip - tail
                    rows.append((i, 2 * skip, 2 * size, 2 * first, text))
                    chars += len(text)
                    if chars >= HELD_CHARS:
                        yield made(batch, rows)
                        rows, chars = [], 0
            if rows:
                yield made(batch, rows)

    return short.unionByName(long.mapInArrow(run, kind).repartition(lines.sparkSession.sparkContext.defaultParallelism * 4))


def long_blocks(lines: DataFrame, reach: int = 0, limit: int = PIECE_CHARS) -> DataFrame:
    """``spaced_blocks`` of ``long_lines``: their columns with ``units`` in place of ``line``. Lines without words give no rows."""
    cut = F.flatten(F.transform(_WORDS("line"), lambda w: F.array(w, F.lit(" "))))
    pieces = long_lines(lines, reach, limit).withColumn("units", cut).where((F.size("units") > 0) & (F.col("size") > 0))
    return pieces.select("id", "block_id", "skip", F.least("size", F.size("units")).alias("size"), "first", "units")


def own_units(spread: DataFrame) -> DataFrame:
    """The units of ``long_lines`` or ``long_blocks`` that are a row's own, numbered as in the uncut line."""
    inside = (F.col("unit_idx") >= F.col("skip")) & (F.col("unit_idx") < F.col("skip") + F.col("size"))
    return spread.where(inside).withColumn("unit_idx", F.col("unit_idx") - F.col("skip") + F.col("first")).drop("skip", "size", "first")


def line_units(lines: DataFrame) -> DataFrame:
    """Screen lines (``words``) as units: each word is one; a line whose words are lines of text stays whole.

    Adds ``unit_idx`` (from 0 in a line), ``text, bbox, confidence`` and a null ``token``; other columns but ``words``
    stay. Lines without words give no units.
    """
    others = [c for c in lines.columns if c != "words"]
    units = lines.select(*others, F.posexplode(F.col("words").cast(WORDS)).alias("unit_idx", "w"))
    return units.select(*others, "unit_idx", "w.text", "w.bbox", "w.confidence", F.lit(None).cast(TOKEN).alias("token"))


def token_units(lines: DataFrame) -> DataFrame:
    """Screen lines (``words`` with ``symbols``, ``tokens``) as units of one token each.

    A token owns the characters from its ``word_position`` on; its box is that around their symbols and its confidence
    the least of their words'. Tokens that start behind the last character give no unit. Lines whose words have no
    symbols are units of ``line_units``, without a token.
    """
    lines = lines.withColumn("words", F.col("words").cast(WORDS))
    of_word = lambda w: F.transform(F.coalesce(w["symbols"], F.array().cast(SYMBOLS)), lambda s: F.struct(s["text"].alias("text"), s["bbox"].alias("bbox"), w["confidence"].alias("confidence")))
    # one entry for each character, as a symbol may have several
    spelled = lambda s: F.transform(F.filter(F.split(s["text"], ""), lambda c: c != ""), lambda c: F.struct(s["bbox"].alias("bbox"), s["confidence"].alias("confidence")))
    rows = lines.withColumn("chars", F.flatten(F.transform(F.flatten(F.transform("words", of_word)), spelled)))
    whole = line_units(rows.where(F.coalesce(F.size("chars"), F.lit(0)) <= 0).drop("chars", "tokens"))
    others = [c for c in lines.columns if c not in ("words", "tokens")]
    units = rows.where(F.size("chars") > 0).select(*others, "chars", F.posexplode(F.col("tokens").cast(f"array<{TOKEN}>")).alias("unit_idx", "token"))
    first = F.col("token.word_position")
    units = units.where((first >= 1) & (first <= F.size("chars")) & (F.length("token.surface_form") > 0))
    own = F.slice("chars", first, F.length("token.surface_form"))
    units = units.withColumn("own", own).select(
        *others, "unit_idx", F.col("token.surface_form").alias("text"),
        union(F.transform("own", lambda c: c["bbox"])).alias("bbox"), F.array_min(F.transform("own", lambda c: c["confidence"])).alias("confidence"), "token",
    )
    return units.unionByName(whole.select(*units.columns))


def with_tokens(lines: DataFrame, tokenize: Callable[[str], list[dict]], text: Column | None = None) -> DataFrame:
    """``lines`` with ``tokens`` from ``tokenize``, a function of a line's text that runs on the workers.

    It returns morphemes as dictionaries with the fields of ``TOKEN``. ``text`` is the line's text unless its symbols
    hold it. Lines without text have no tokens; errors of ``tokenize`` are not hidden.
    """
    ship(lines.sparkSession)
    if text is None:
        symbols = F.flatten(F.transform(F.col("words").cast(WORDS), lambda w: F.coalesce(w["symbols"], F.array().cast(SYMBOLS))))
        text = F.array_join(F.transform(symbols, lambda s: s["text"]), "")

    @F.pandas_udf(f"array<{TOKEN}>")
    def tokens(texts):
        return texts.map(lambda t: tokenize(t) if t else [])

    return lines.withColumn("tokens", tokens(text))


def split_visual_lines(chars: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """``chars`` (``ch, bbox``) with ``piece``: text that wraps starts a new piece where a character overlaps the one
    before it by less than half of its own height."""
    before = Window.partitionBy(*keys).orderBy(order)
    last, own = F.lag("bbox").over(before), F.col("bbox")
    wraps = F.coalesce(shared_height(last, own) < (own["y1"] - own["y0"]) * 0.5, F.lit(False))
    return chars.withColumn("wraps", wraps.cast("int")).withColumn("piece", F.sum("wraps").over(before)).drop("wraps")


def glyph_lines(texts: DataFrame, keys: list[str], glyphs: str = "glyphs", width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Texts as they are set (``keys``, ``glyphs``: each character ``ch`` with its ``bbox``) as screen lines: ``keys, piece``
    (from 0), ``words`` of one word with its symbols.

    Glyphs without width or height, or beyond a screen of ``width`` by ``height``, are dropped; a text that wraps is a line
    for each piece; pieces of nothing but white space give none, and are not counted. Null boxes are not set anywhere.
    """
    chars = texts.select(*keys, F.posexplode(F.col(glyphs).cast(f"array<struct<ch: string, bbox: {BOX}>>")).alias("ord", "g")).select(*keys, "ord", "g.ch", "g.bbox")
    b = F.col("bbox")
    chars = chars.where((b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))
    if width is not None and height is not None:
        chars = chars.where(~outside(b, width, height))
    rows = split_visual_lines(chars, keys)
    symbols = F.array_sort(F.collect_list(F.struct("ord", "ch", "bbox")), lambda a, c: F.when(a["ord"] < c["ord"], -1).when(a["ord"] > c["ord"], 1).otherwise(0))
    grouped = rows.groupBy(*keys, "piece").agg(symbols.alias("s"))
    text = F.array_join(F.transform("s", lambda s: s["ch"]), "")
    grouped = grouped.withColumn("text", text).where(F.btrim("text", F.lit(V.SPACES)) != "")
    word = F.struct(F.col("text"), F.lit(100.0).alias("confidence"), union(F.transform("s", lambda s: s["bbox"])).alias("bbox"), F.transform("s", lambda s: F.struct(s["ch"].alias("text"), s["bbox"].alias("bbox"))).alias("symbols"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("piece")) - 1
    return grouped.select(*keys, place.alias("piece"), F.array(word).alias("words"))


def with_visual_lines(units: DataFrame, keys: list[str], idx: str = "unit_idx") -> DataFrame:
    """``units`` with ``visual``: the number of a unit's visual line, which ends where a unit shares no height with the one before."""
    order = Window.partitionBy(*keys).orderBy(idx)
    new = (~on_one_line(F.lag("bbox").over(order), F.col("bbox"))).cast("int")
    return units.withColumn("new", new).withColumn("visual", F.sum("new").over(order).cast("int")).drop("new")


def blocks_of(units: DataFrame, keys: list[str], idx: str = "unit_idx") -> DataFrame:
    """``units`` by block: texts in order as ``units``, ``visual`` where boxes tell lines apart, and the rows as ``rows``.

    ``spread_units(.., along=("row",))`` gives the rows back. A block is one screen block, never a whole table.
    """
    if "bbox" in units.columns:
        units = with_visual_lines(units, keys, idx)
    row = F.struct(F.col(idx).alias("at"), "text", *(c for c in units.columns if c not in keys and c not in (idx, "text")))
    grouped = units.groupBy(*keys).agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)).alias("row"))
    more = [F.transform("row", lambda r: r["visual"]).alias("visual")] if "bbox" in units.columns else []
    return grouped.select(*keys, F.transform("row", lambda r: r["text"]).alias("units"), *more, F.transform("row", lambda r: r.dropFields("at", "text")).alias("row"))


def read_ocr(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Recognised text (JSON ``{blocks: [{paragraphs: [{lines: [{words}]}]}]}``) as lines: ``block_id, line_id, words``.

    Lines of all paragraphs of a block are numbered through. Null or broken payloads give no lines.
    """
    kind = f"struct<blocks: array<struct<paragraphs: array<struct<lines: array<struct<words: {WORDS}>>>>>>>"
    others = [c for c in df.columns if c != payload]
    blocks = df.select(*others, F.posexplode(F.from_json(payload, kind)["blocks"]).alias("block_id", "b"))
    lines = F.flatten(F.transform("b.paragraphs", lambda p: p["lines"]))
    return blocks.select(*others, "block_id", F.posexplode(lines).alias("line_id", "l")).select(*others, "block_id", "line_id", "l.words")


def choose_route(dom_lines: DataFrame, ocr_lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each page with ``route``: ``DOM`` where the page has lines of its own, else ``OCR`` (without meaning or kind)."""
    own = dom_lines.select(*keys).distinct()
    rest = ocr_lines.join(own, keys, "left_anti")
    return dom_lines.withColumn("route", F.lit("DOM")).unionByName(rest.withColumn("route", F.lit("OCR")), allowMissingColumns=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, if it is read from fewer files than that.

    A few files hold few row groups, and rules cost far more time than reading; tables of many files are left alone.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df

"""Lists of phrases as tables: reading with a check of their form, merging, writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import kept
from ..functions.text import trim

VERSION = 1
_BAD = "not a list of phrases: expected a JSON array of strings or an object with such an array as terms"


def _terms(value: Column) -> Column:
    """The strings of a parsed list or of its ``terms``; anything else is an error."""
    kind = F.schema_of_variant(value)
    listed = F.when(kind.startswith("ARRAY"), value).when(kind.startswith("OBJECT"), F.try_variant_get(value, "$.terms", "variant"))
    # members that are not strings make the array's type another one
    strings = F.schema_of_variant(listed).isin("ARRAY<STRING>", "ARRAY<VOID>")
    empty = F.to_json(listed) == "[]"
    return F.when(strings | empty, F.try_variant_get(listed, "$", "array<string>")).otherwise(F.raise_error(F.lit(_BAD)).cast("array<string>"))


def parse_phrases(files: DataFrame, text: str = "value") -> DataFrame:
    """``ord, term``: the phrases of JSON texts, numbered through each text. A text of another form raises an error.

    Other columns stay, but for the text itself.
    """
    parsed = files.withColumn("_list", F.try_parse_json(text))
    terms = F.when(F.col("_list").isNull(), F.raise_error(F.lit(_BAD)).cast("array<string>")).otherwise(_terms(F.col("_list")))
    others = [c for c in files.columns if c != text]
    return parsed.select(*others, F.posexplode(terms).alias("ord", "term"))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """``file, ord, term`` of all phrase files under ``path``."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return parse_phrases(files).select("file", "ord", "term")


def _numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with their place in the order, from 0. Rows are sorted over ranges; only how many each range has is added up
    in one place."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = kept(parts.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    both = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return both.withColumn(name, (F.col("_before") + inside).cast("int")).drop("_at", "_part", "_before")


def merge_phrases(*lists: DataFrame) -> DataFrame:
    """Phrases (``ord, term``) of several lists, trimmed, without empty ones, each once: ``ord`` (from 0) and ``term``.

    The order is that of first appearance: earlier lists first, then by ``ord``; null terms are left out.
    """
    all_of = reduce(DataFrame.unionByName, (df.select(F.lit(i).alias("list"), F.col("ord").cast("long").alias("ord"), trim(F.col("term")).alias("term")) for i, df in enumerate(lists)))
    first = all_of.where("term != ''").groupBy("term").agg(F.min(F.struct("list", "ord")).alias("at"))
    return _numbered(first, "ord", "at", "term").select("ord", "term")


def register_offered(phrases: DataFrame, replayed: DataFrame) -> DataFrame:
    """``phrases`` with the texts that edits offered (``state`` offered in ``edits.replay``) behind them, page by page."""
    offered = replayed.where("state = 'offered'").select(F.col("page_id").alias("ord"), F.col("text").alias("term"))
    return merge_phrases(phrases, offered)


def terms_of(phrases: DataFrame, limit: int = 10_000) -> tuple[str, ...]:
    """The phrases in order, for ``Rules.terms``. A list of more than ``limit`` is an error: rules travel to every task."""
    rows = phrases.orderBy("ord").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} phrases")
    return tuple(r.term for r in rows)


def phrases_json(phrases: DataFrame) -> DataFrame:
    """One row ``value``: the list as JSON with its version, in order."""
    terms = F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda t: t["term"])
    return phrases.agg(F.to_json(F.struct(F.lit(VERSION).alias("version"), terms.alias("terms"))).alias("value"))

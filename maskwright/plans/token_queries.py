"""Registered queries over morphemes of a dictionary made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.decide import decide
from ..operators.names import with_name_runs
from ..operators.spans import spread_units, with_spans
from ..sources.tokenizer import dictionary_of, with_dictionary_tokens
from ..sources.units import lines_of, spread

#: Contexts of the words, and words that are said at least so often to be in the dictionary.
CONTEXTS, SAID = 8, 3


def dictionary_tables(conversations):
    """A dictionary's tables: words that are often said, the oftener the cheaper, with contexts by their length; the cost of a
    context after another falls with how often it follows."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("(\\p{L}+)"), F.lit(1))
    said = conversations.select(F.posexplode(words).alias("n", "surface"), "conv_id", "turn")
    often = said.groupBy("surface").agg(F.count("*").alias("n")).where(F.col("n") >= SAID)
    context = (F.length("surface") % (CONTEXTS - 1) + 1).cast("int")
    kind = F.when(F.length("surface") <= 3, "助詞").otherwise("名詞")
    detail = F.when(F.length("surface") <= 3, "一般").when(F.length("surface") % 4 == 0, "固有名詞").otherwise("一般")
    table = often.select("surface", context.alias("left_id"), context.alias("right_id"), (3000 - F.least(F.floor(F.log2("n") * 200), F.lit(2500))).cast("int").alias("cost"), kind.alias("pos"), detail.alias("pos_detail_1"), F.lit("*").alias("pos_detail_2"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct((F.length(F.col("w")[i - 1]) % (CONTEXTS - 1) + 1).alias("right_id"), (F.length(F.col("w")[i]) % (CONTEXTS - 1) + 1).alias("left_id")))
    follows = conversations.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(pairs).alias("p")).groupBy("p.right_id", "p.left_id").agg(F.count("*").alias("n"))
    return table, follows.select("right_id", "left_id", (-F.floor(F.log2("n") * 20)).cast("int").alias("cost"))


def _tokens(spark, sf_dir):
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    dictionary = dictionary_of(*dictionary_tables(talks))
    lines = lines_of(spread(talks).select(F.struct("conv_id", "turn").alias("key"), F.lower("text").alias("text")), "key")
    return with_dictionary_tokens(lines, dictionary, F.col("line"))


def dictionary_tokens(spark, sf_dir):
    """Morphemes of every line of the conversations."""
    return _tokens(spark, sf_dir).select("id.conv_id", "id.turn", "block_id", F.posexplode("tokens").alias("unit_idx", "t")).select("conv_id", "turn", "block_id", "unit_idx", "t.*")


def dictionary_decide(spark, sf_dir):
    """The whole cascade over those morphemes: patterns over lines, names over morphemes, each one's own verdict."""
    blocks = _tokens(spark, sf_dir).select(F.col("id.conv_id").alias("conv_id"), F.col("id.turn").alias("turn"), "block_id", "tokens", F.transform("tokens", lambda t: t["surface_form"]).alias("units"))
    units = spread_units(with_spans(blocks.where(F.size("units") > 0)))
    return decide(with_name_runs(units, ["conv_id", "turn", "block_id"])).select("conv_id", "turn", "block_id", "unit_idx", "text", "mask", "reason")


QUERIES = {f.__name__: f for f in (dictionary_tokens, dictionary_decide)}
#: The cheapest path is found step by step; tests hold it against every path.
ORACLE_SQL: dict[str, str] = {}

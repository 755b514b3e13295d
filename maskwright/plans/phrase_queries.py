"""Registered queries over phrase tables of any length, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.phrase_search import with_phrases
from ..operators.spans import spread_units
from ..sources.units import lines_of, spread, word_blocks
from . import oracle


def _pairs(spark, sf_dir):
    """Phrases: every two words that follow each other in a turn of a conversation."""
    words = F.regexp_extract_all("text", F.lit("([^ \\t\\r\\n\\x0B\\f]+)"), F.lit(1))
    pair = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.col("w")[i - 1], F.col("w")[i]))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(words.alias("w")).where(F.size("w") > 1)
    return turns.select(F.explode(pair).alias("term"))


def _found(spark, sf_dir, full):
    blocks = word_blocks(lines_of(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), "doc_id"))
    units = spread_units(with_phrases(blocks, _pairs(spark, sf_dir), full))
    return units.where("user_kept").select(F.col("id").alias("doc_id"), "block_id", "unit_idx", "text")


def phrase_table_protect(spark, sf_dir):
    """Words of the documents that any of a hundred thousand phrases covers in part."""
    return _found(spark, sf_dir, False)


def phrase_table_cover(spark, sf_dir):
    """Words of the documents that the same phrases cover wholly."""
    return _found(spark, sf_dir, True)


def _sql(whole: bool) -> str:
    """Every place of a block with every length of a phrase; lengths that no phrase of the same beginning has are skipped."""
    head = 4
    return f"""WITH source AS ({oracle.DOC_WORDS}), u AS (SELECT k1, k2, unit_idx, text, {oracle.DROPPED('text')} AS p FROM source),
        o AS (SELECT *, CAST(sum(length(p)) OVER (PARTITION BY k1, k2 ORDER BY unit_idx) - length(p) AS BIGINT) AS p0 FROM u),
        blocks AS (SELECT k1, k2, string_agg(p, '' ORDER BY unit_idx) AS jp FROM u GROUP BY ALL),
        w AS (SELECT regexp_extract_all(text, '[^ \\t\\r\\n\\x0B\\f]+') AS w FROM conversations),
        phrases AS (SELECT DISTINCT {oracle.DROPPED('v')} AS p FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS v FROM w)),
        heads AS (SELECT DISTINCT left(p, {head}) AS head, length(p) AS n FROM phrases WHERE p <> ''),
        shorts AS (SELECT DISTINCT n FROM heads WHERE n < {head}),
        places AS (SELECT k1, k2, jp, unnest(range(0, length(jp))) AS i FROM blocks),
        tried AS (SELECT k1, k2, i, n, substr(jp, i + 1, n) AS s FROM places JOIN heads ON substr(jp, i + 1, {head}) = head AND i + n <= length(jp) WHERE n >= {head}
            UNION ALL SELECT k1, k2, i, n, substr(jp, i + 1, n) FROM places JOIN shorts ON i + n <= length(jp)),
        held AS (SELECT DISTINCT k1, k2, unnest(range(i, i + n)) AS pos FROM tried SEMI JOIN phrases ON s = phrases.p),
        owned AS (SELECT k1, k2, unit_idx, text, length(p) AS size, unnest(range(p0, p0 + length(p))) AS pos FROM o)
        SELECT k1 AS doc_id, k2 AS block_id, unit_idx, text FROM owned SEMI JOIN held USING (k1, k2, pos)
        GROUP BY k1, k2, unit_idx, text, size {'HAVING count(*) = size' if whole else ''}"""


QUERIES = {f.__name__: f for f in (phrase_table_protect, phrase_table_cover)}
ORACLE_SQL = {"phrase_table_protect": _sql(False), "phrase_table_cover": _sql(True)}

"""Words of lines with their flags, one row each, against units made natively and spread."""

import random

from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators.decide import decide
from maskwright.operators.spans import FLAGS, spanned_words, spread_units, with_spans
from maskwright.sources.units import long_lines, own_units, spaced_blocks, word_blocks
from maskwright.vocab import SPACES, Rules

PARTS = [*"aZ019.,-_%+@(〒＋－件％：ΣİＡ＠é😀\0#", "ms", "no", "sa", "ve", "ann@x.org", "a.b.c", "1,234%", " ", "\t", "　", "  "]


def test_words_against_spread_units(spark):
    r = random.Random(5)
    texts = ["".join(r.choices(PARTS, k=r.choice([0, 1, 9, 60]))) for _ in range(400)] + [None, " ", "save no\tid"]
    lines = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, block_id int, line string").repartition(3)
    rules = Rules(terms=("ab", "no id"))
    columns = ["id", "block_id", "unit_idx", "text", *FLAGS]
    for gaps, blocks in ((True, spaced_blocks(lines)), (False, word_blocks(lines))):
        want = spread_units(with_spans(blocks, rules)).select(columns).where("unit_idx % 2 = 0" if gaps else "true")
        got = spanned_words(lines, rules, gaps=gaps).select(columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_forms_of_texts(spark):
    """Shortcuts for plain texts give what the rules say of any."""
    r = random.Random(6)
    texts = ["".join(r.choices([*SPACES, *PARTS, "\u0085", " ", "、", "ぁ"], k=r.choice([0, 1, 2, 5]))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    wide = dict(zip(map(ord, "Ａ＠"), "A@", strict=True))
    for row in rows.select("t", T.trim(F.col("t")).alias("trimmed"), T.fold(F.col("t")).alias("folded"), T.is_long(F.col("t")).alias("long")).collect():
        assert row.trimmed == row.t.strip(SPACES)
        if "Σ" not in row.t and "İ" not in row.t:
            assert row.folded == row.t.translate(wide).lower()
        assert row.long == (len(row.t.encode("utf-16-be")) // 2 >= 8)


def test_missing_columns_are_no_evidence(spark):
    units = spark.createDataFrame([("ann", None), ("12", "digit-run"), ("save", None)], "text string, line_reason string")
    nulls = units.selectExpr("*", "CAST(NULL AS BOOLEAN) user_kept", "CAST(NULL AS DOUBLE) confidence", "CAST(NULL AS STRING) semantic")
    columns = ["text", "mask", "reason", "confidence", "semantic", "name_run"]
    assert decide(units).select(columns).collect() == decide(nulls).select(columns).collect()


def test_pieces_of_long_lines_come_many_at_a_time(spark):
    """Words of pieces, which a task hands on many at a time, are those of the line."""
    lines = spark.range(30).selectExpr("id", "0 AS block_id", "repeat(concat('the word', id, ' '), 100) AS line").coalesce(1)
    pieces = long_lines(lines, 6, 50)
    rules, flags = Rules(terms=("word7the",)), ("line_reason", "user_kept")
    columns = ["id", "unit_idx", "text", *flags]
    got = own_units(spanned_words(pieces, rules, flags, gaps=True)).select(columns)
    want = spanned_words(lines, rules, flags, gaps=True).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.where("user_kept").count() == 198
    assert pieces.count() > 600

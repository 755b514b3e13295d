"""Lines cut in pieces against whole ones; runs merged in the order of units against runs merged by windows."""

import random
import resource

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.operators.decide import decide, merge_ordered_runs, merge_runs
from maskwright.operators.spans import spread_units, with_spans
from maskwright.sources.units import long_blocks, own_units, pieces_of, spaced_blocks, word_blocks
from maskwright.vocab import Rules

WORDS = ["joe@shop.example", "03-5555-0199", "95%", "40ms", "the", "and", "of", "x.y.z", "，", "é", "plain", "12"]


@given(st.lists(st.sampled_from([*WORDS, " ", "\t ", "   "]), max_size=40), st.integers(1, 30), st.integers(0, 12))
@settings(max_examples=300, deadline=None)
def test_pieces_hold_every_word_once(parts, limit, reach):
    line = " ".join(parts)
    found, at = [], 0
    for text, skip, tail, before in pieces_of(line, limit, reach):
        words = text.split()
        assert before == at
        found += words[skip : len(words) - tail]
        at = len(found)
        # the neighbours' words have as many characters of phrases as phrases may reach, where there are that many
        held = len("".join(words[:skip]).replace("，", ""))
        assert held >= min(reach, len("".join(line.split()[: at - (len(words) - tail - skip)]).replace("，", "")))
    assert found == line.split()


def test_as_uncut(spark):
    rng = random.Random(6)
    lines = [(i, 0, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 400, 3000])))) for i in range(30)] + [(100, 0, None), (101, 0, " \t "), (102, 0, "w" * 5000)]
    df = spark.createDataFrame(lines, "id long, block_id int, line string")
    terms = ("the and", "of the and", "plain 12 é")
    rules, flags = Rules(terms=terms), ("line_reason", "unit_metric", "user_kept", "label_kept")
    columns = ["id", "block_id", "unit_idx", "text", *flags]
    whole = spread_units(with_spans(spaced_blocks(df), rules, flags)).select(columns)
    cut = own_units(spread_units(with_spans(long_blocks(df, max(map(len, terms)), 97), rules, flags))).select(columns)
    assert whole.count() == cut.count() and whole.exceptAll(cut).count() == 0
    assert long_blocks(df, 5, 97).count() > 1000 and long_blocks(df.where("false")).count() == 0


def test_a_line_of_many_megabytes(spark):
    """A line far beyond what one batch should hold: as many pieces as it has quarters of a megabyte, each small."""
    n = 400_000
    df = spark.range(1).select(F.col("id"), F.lit(0).alias("block_id"), F.repeat(F.lit("joe@shop.example plain 03-5555-0199 "), n).alias("line"))
    blocks = long_blocks(df)
    assert blocks.count() >= n * 35 // (1 << 18)
    units = own_units(spread_units(with_spans(blocks, flags=("line_reason",)))).where("line_reason IS NOT NULL")
    counts = {r.line_reason: r["count"] for r in units.groupBy("line_reason").count().collect()}
    assert counts == {"email": n, "digit-run": n} and units.agg(F.max("unit_idx")).first()[0] == 6 * n - 2
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 4 << 20  # kilobytes


def test_ordered_runs(spark):
    rng = random.Random(7)
    rows = [(i, j, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))) for i in range(60) for j in range(3)] + [(None, 0, "12 34 joe@a.b"), (99, 0, "03 04 " * 9000)]
    blocks = word_blocks(spark.createDataFrame(rows, "id long, block_id int, line string").repartition(5))
    units = spread_units(with_spans(blocks))
    got = merge_ordered_runs(decide(units), ["id", "block_id"])
    want = merge_runs(decide(units), ["id", "block_id"])
    assert got.columns == want.columns and got.count() == want.count() and want.exceptAll(got).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "Sort" not in plan
    # structs as keys, and nothing at all
    keyed = decide(units.withColumn("id", F.struct("id", "block_id")))
    assert merge_ordered_runs(keyed, ["id"]).count() == want.count() and merge_ordered_runs(decide(units.where("false")), ["id", "block_id"]).count() == 0
    with pytest.raises(Exception, match="in order"):
        merge_ordered_runs(decide(units).orderBy(F.desc("unit_idx")).coalesce(1).where("id = 99"), ["id", "block_id"]).collect()


def test_glyphs(spark):
    """Wrapped texts, glyphs of no size, beyond the screen, blank pieces, nulls."""
    from maskwright.sources.units import glyph_lines

    at = lambda c, x, y, w=8.0, h=10.0: (c, (x, y, x + w, y + h))
    rows = [
        (1, [at("a", 0.0, 0.0), at(" ", 8.0, 0.0, 0.0), at("b", 8.0, 4.0), at(" ", 0.0, 20.0), at("c", 0.0, 41.0), at("d", 8.0, 47.0)]),
        (2, [at("x", 500.0, 0.0), at("y", 0.0, 0.0, 8.0, 0.0)]), (3, None), (4, []), (5, [at(" ", 0.0, 0.0), ("z", None)]),
    ]
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    df = spark.createDataFrame(rows, f"id int, glyphs array<struct<ch: string, bbox: {box}>>").withColumn("piece", F.lit("clash"))
    lines = glyph_lines(df, ["id"], width=F.lit(100), height=F.lit(100)).orderBy("id", "piece").collect()
    assert [(r.id, r.piece, r.words[0].text, len(r.words[0].symbols), tuple(r.words[0].bbox)) for r in lines] == [(1, 0, "ab", 2, (0.0, 0.0, 16.0, 14.0)), (1, 1, "c", 1, (0.0, 41.0, 8.0, 51.0)), (1, 2, "d", 1, (8.0, 47.0, 16.0, 57.0))]

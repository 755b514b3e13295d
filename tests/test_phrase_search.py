"""Searches for many phrases against a search for one after another."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.operators import spans as S
from maskwright.operators.phrase_search import Automaton, Sieve, automata, with_phrases
from maskwright.operators.spans import with_spans
from maskwright.vocab import Rules


def _covered(spans, size):
    out = np.zeros(size, bool)
    for a, b in spans.tolist():
        out[a:b] = True
    return out.tolist()


@given(st.lists(st.text("abc", max_size=6), max_size=12), st.text("abc\0d", max_size=80))
@settings(max_examples=300, deadline=None)
def test_as_one_by_one(phrases, text):
    spans = Automaton(phrases).spans(text)
    assert _covered(spans, len(text)) == _covered(S.one_by_one(text, [p for p in phrases if p]), len(text))


def test_lanes_and_long_phrases():
    """Texts of many lanes, phrases longer than a lane, every occurrence over the seams."""
    rng = random.Random(5)
    for _ in range(20):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 4000)))
        phrases = [text[a : a + rng.choice([1, 3, 17, 700])] for a in (rng.randrange(len(text)) for _ in range(6))] + ["bbbbbbbbbbab" * 40]
        assert _covered(Automaton(phrases).spans(text), len(text)) == _covered(S.one_by_one(text, phrases), len(text))


def test_longest_at_each_end():
    found = Automaton(["he", "she", "hers", "his"]).ends("ushers his")
    assert found.tolist() == [0, 0, 0, 3, 0, 4, 0, 0, 0, 3]
    assert Automaton([]).ends("abc").tolist() == [0, 0, 0] and Automaton(["a"]).ends("").tolist() == []
    assert Automaton(["日本", "😀"]).spans("x日本😀").tolist() == [[1, 3], [3, 4]]


def test_linear_in_repeated_texts():
    """A text of one letter and phrases of it: the states move on, they never begin anew."""
    automaton = Automaton(["a" * n for n in range(1, 400)])
    assert automaton.ends("a" * 50_000)[-1] == 399


def test_many_terms_as_few(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 4)))
    rows = [(i, [word() for _ in range(rng.randrange(12))]) for i in range(40)]
    terms = tuple(f"{word()} {word()}" for _ in range(S.FEW * 3))
    assert len(S._phrases(terms)) > S.FEW
    df = spark.createDataFrame(rows, "b int, units array<string>")
    got = {r.b: r.user_kept for r in with_spans(df, Rules(terms=terms), ("user_kept",)).collect()}
    for b, units in rows:
        breaks = np.append(1, np.zeros(max(len(units) - 1, 0), np.int64))[: len(units)]
        assert got[b] == S.protected(units, S._phrases(terms), False, breaks).tolist()


def test_phrase_tables(spark):
    """Over one automaton and over several, in part and wholly; nulls, empty blocks, marks, no phrases, clashing names."""
    rows = [(1, ["山田", "太郎", "様"]), (2, ["株式", "会社", "ABC"]), (3, None), (4, []), (5, [None, ",", "a\0b", "ａＢ"]), (6, ["x" * 5000, "y"])]
    df = spark.createDataFrame(rows, "b int, units array<string>").withColumn("_held", F.lit("clash")).withColumn("user_kept", F.lit("clash"))
    phrases = spark.createDataFrame([("山田 太郎",), ("会社",), (None,), (" 、",), ("ab",), ("xxy",), ("会社",)], "term string")
    part = {1: [True, True, False], 2: [False, True, True], 3: None, 4: [], 5: [False, False, False, True], 6: [True, True]}
    whole = {**part, 2: [False, True, False], 6: [False, True]}
    for most in (1 << 20, 3):
        assert len(list(automata(phrases, most=most))) == (1 if most > 3 else 5)
        got = with_phrases(df, phrases, most=most)
        assert got.columns == ["b", "units", "_held", "user_kept"]
        assert {r.b: r.user_kept for r in got.collect()} == part
        assert {r.b: r.user_kept for r in with_phrases(df, phrases, full=True, most=most).collect()} == whole
    none = with_phrases(df, phrases.where("term IS NULL")).collect()
    assert {r.b: r.user_kept for r in none} == {b: None if u is None else [False] * len(u) for b, u in rows}
    assert with_phrases(df.where("false"), phrases).count() == 0


def test_slices_of_blocks(spark):
    """Blocks are cut apart by the bytes of their units, and none is lost."""
    rows = [(i, ["word"] * 500) for i in range(40)] + [(100, []), (101, ["é" * 9000])]
    batch = spark.createDataFrame(rows, "b int, units array<string>").toArrow().combine_chunks().to_batches()[0]
    parts = list(S.slices_of(batch, 8000))
    assert [b for p in parts for b in p.column(0).to_pylist()] == [b for b, _ in rows]
    assert all(p.num_rows == 1 or sum(len(u) for us in p.column(1).to_pylist() for u in us) <= 8000 for p in parts) and len(parts) > 10


def test_phrases_beyond_one_automaton(spark):
    """However many phrases there are, blocks are read once: by sieve and join the same flags as one after another."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 5, 9, 40])))
    words = [word() for _ in range(60)]
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(15))]) for i in range(80)]
    terms = [f"{rng.choice(words)} {rng.choice(words)}" for _ in range(400)] + ["", "日本 語", "a"]
    df = spark.createDataFrame(rows, "b int, units array<string>").repartition(3)
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    for full in (False, True):
        got = {r.b: r.user_kept for r in with_phrases(df, table, full, most=100).collect()}
        for b, units in rows:
            breaks = np.append(1, np.zeros(max(len(units) - 1, 0), np.int64))[: len(units)]
            assert got[b] == S.protected(units, S._phrases(tuple(terms)), full, breaks).tolist()


def test_sieve_misses_nothing():
    rng = random.Random(1)
    text = "".join(rng.choice("abcd日😀") for _ in range(5000))
    phrases = sorted({text[a : a + n] for a in range(0, 4900, 7) for n in (1, 2, 4, 5, 8, 9, 33)[: 1 + a % 7]} | {"zzzzzzzz"})
    sieve = Sieve(1 << 20, [len(p) for p in phrases])
    at = sieve.words_of(phrases)
    np.bitwise_or.at(sieve.held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    found, true = set(map(tuple, sieve.spans(text).tolist())), set(map(tuple, S.one_by_one(text, phrases).tolist()))
    assert true <= found and len(found - true) < len(true) / 10 and len(sieve.spans("")) == 0

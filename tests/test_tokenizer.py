"""Morphemes by the cheapest path, against every path."""

import random

from pyspark.sql import functions as F

from maskwright.operators.names import with_name_runs
from maskwright.operators.trie import Trie
from maskwright.sources.tokenizer import CONNECTION_SCHEMA, KINDS, WORD_SCHEMA, Dictionary, dictionary_of, with_dictionary_tokens
from maskwright.sources.units import token_units

NOUN, PERSON = ("名詞", "一般", "*"), ("名詞", "固有名詞", "人名")
WORDS = [
    ("東京", 1, 1, 100, "名詞", "固有名詞", "地域"), ("東", 1, 1, 400, *NOUN), ("京都", 1, 1, 120, "名詞", "固有名詞", "地域"), ("都", 2, 2, 150, "名詞", "接尾", "地域"), ("に", 3, 3, 50, "助詞", "格助詞", "一般"),
    ("住む", 4, 4, 200, "動詞", "自立", "*"), ("山田", 1, 1, 200, *PERSON), ("山", 1, 1, 300, *NOUN), ("田", 1, 1, 300, *NOUN), ("太郎", 1, 1, 250, *PERSON), ("の", 3, 3, 40, "助詞", "連体化", "*"),
]
COSTS = [(1, 2, -50), (1, 1, 80), (2, 3, -30), (1, 3, -30), (3, 4, -20), (0, 1, 10), (4, 0, -10)]


def _cost(dictionary, path):
    """Own costs and those of contexts, the text's borders included."""
    contexts = [0, *(e[1] for *_, e in path)]
    lefts = [*(e[0] for *_, e in path), 0]
    return sum(e[2] for *_, e in path) + sum(dictionary.costs.get(pair, 0) for pair in zip(contexts, lefts, strict=True))


def _every_path(dictionary, text):
    by_start = {}
    for start, end, known, entry in dictionary.lattice(text):
        by_start.setdefault(start, []).append((start, end, known, entry))

    def walk(at):
        if at == len(text):
            yield []
        for word in by_start.get(at, ()):
            for rest in walk(word[1]):
                yield [word, *rest]

    return walk(0)


def test_known_words():
    d = Dictionary(WORDS, COSTS)
    tokens = d.tokenize("東京都に住む")
    assert [(t["surface_form"], t["pos"], t["pos_detail_1"], t["word_type"], t["word_position"]) for t in tokens] == [
        ("東京", "名詞", "固有名詞", "KNOWN", 1), ("都", "名詞", "接尾", "KNOWN", 3), ("に", "助詞", "格助詞", "KNOWN", 4), ("住む", "動詞", "自立", "KNOWN", 5),
    ]
    # without the context's bonus the other reading is cheaper
    assert [t["surface_form"] for t in Dictionary([*WORDS[:1], *WORDS[1:3], ("都", 2, 2, 900, *NOUN)]).tokenize("東京都")] == ["東", "京都"]


def test_unknown_words():
    parts = lambda text, d=Dictionary(): [(t["surface_form"], t["pos"], t["word_type"]) for t in d.tokenize(text)]
    assert parts("") == [] and parts("abc 12-x") == [("abc", "名詞", "UNKNOWN"), (" ", "記号", "UNKNOWN"), ("12", "名詞", "UNKNOWN"), ("-", "記号", "UNKNOWN"), ("x", "名詞", "UNKNOWN")]
    assert [p[0] for p in parts("ログイン中")] == ["ログイン", "中"] and "".join(p[0] for p in parts("😀あ漢字カナé\n")) == "😀あ漢字カナé\n"
    assert [p[0] for p in parts("山田さん", Dictionary(WORDS))] == ["山田", "さん"]


def test_cheapest_by_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        words = [("".join(rng.choice("東京都に") for _ in range(rng.randrange(1, 4))), rng.randrange(4), rng.randrange(4), rng.randrange(-200, 9000), *NOUN) for _ in range(rng.randrange(12))]
        d = Dictionary(words, [(rng.randrange(4), rng.randrange(4), rng.randrange(-3000, 3000)) for _ in range(8)])
        text = "".join(rng.choice("東京都にa1 ") for _ in range(rng.randrange(1, 9)))
        costs = [_cost(d, p) for p in _every_path(d, text)]
        tokens = d.tokenize(text)
        assert "".join(t["surface_form"] for t in tokens) == text
        fits = [_cost(d, p) for p in _every_path(d, text) if [(a + 1, text[a:b], k, e[3:6]) for a, b, k, e in p] == [(t["word_position"], t["surface_form"], t["word_type"], (t["pos"], t["pos_detail_1"], t["pos_detail_2"])) for t in tokens]]
        assert min(fits) == min(costs)


def test_trie():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(30)})
    text = "".join(rng.choice("abcd") for _ in range(500))
    want = sorted((i, len(w), k) for k, w in enumerate(words) for i in range(len(text)) if text.startswith(w, i))
    assert list(zip(*(x.tolist() for x in Trie(words).matches(text)), strict=True)) == want
    assert [len(x) for x in Trie([]).matches("abc")] == [0, 0, 0]


def test_tables_and_screens(spark):
    """From tables to units with boxes and name runs; lines without text, nulls, repeated words, no dictionary."""
    words = spark.createDataFrame([*WORDS, WORDS[0], (None, 1, 1, 1, *NOUN), ("", 1, 1, 1, *NOUN)], WORD_SCHEMA)
    d = dictionary_of(words, spark.createDataFrame([*COSTS, (1, 2, -40)], CONNECTION_SCHEMA))
    assert sum(map(len, d.entries.values())) == len(WORDS) and d.costs[1, 2] == -50
    symbol = lambda c, i: (c, (float(i), 0.0, float(i + 1), 1.0))
    text = "山田 太郎の東京"
    rows = [(1, [(text, 90.0, None, [symbol(c, i) for i, c in enumerate(text)])]), (2, None), (3, [("", 1.0, None, [])])]
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    lines = spark.createDataFrame(rows, f"line int, words array<struct<text: string, confidence: double, bbox: {box}, symbols: array<struct<text: string, bbox: {box}>>>>")
    units = with_name_runs(token_units(with_dictionary_tokens(lines, d)), ["line"]).where("line = 1").orderBy("unit_idx").collect()
    assert [(u.text, u.bbox.x0, u.bbox.x1, u.token.word_type, u.name_run) for u in units] == [
        ("山田", 0.0, 2.0, "KNOWN", "kanji-run"), (" ", 2.0, 3.0, "UNKNOWN", "kanji-run"), ("太郎", 3.0, 5.0, "KNOWN", "kanji-run"), ("の", 5.0, 6.0, "KNOWN", None), ("東京", 6.0, 8.0, "KNOWN", None),
    ]
    plain = spark.createDataFrame([("ab1",), (None,), ("",)], "t string")
    assert [len(r.tokens) for r in with_dictionary_tokens(plain, Dictionary(), F.col("t")).collect()] == [2, 0, 0]


def test_long_runs():
    """One class over a whole long text; every beginning of it is a way, but no place has more than a few."""
    for text in ("x" * 30_000, "漢" * 5_000, "あ" * 5_000):
        assert "".join(t["surface_form"] for t in Dictionary().tokenize(text)) == text
    assert len({k.name for k in KINDS}) == len(KINDS)


def test_together_and_once(spark):
    """Texts looked up together are parted as each alone; a query that filters by its tokens parts them once."""
    d = Dictionary(WORDS, COSTS)
    texts = ["東京都に住む", None, "", "山田太郎", "京", "都に東", "x" * 70_000, "山田さん"]
    assert list(d.tokenize_all(texts)) == [d.tokenize(t or "") for t in texts] and list(d.tokenize_all([])) == []
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, line string")
    parted = with_dictionary_tokens(lines, d, F.col("line")).select("id", F.transform("tokens", lambda t: t["surface_form"]).alias("units")).where(F.size("units") > 0)
    plan = parted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r.id: r.units for r in parted.collect()} == {i: [w["surface_form"] for w in d.tokenize(t)] for i, t in enumerate(texts) if t}

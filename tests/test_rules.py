import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import text as T
from maskwright.operators import spans
from maskwright.operators.decide import decide, merge_runs
from maskwright.operators.edits import bulk_unmask, click_unmask, column_members
from maskwright.operators.names import with_name_runs
from maskwright.operators.spans import spread_units, with_spans
from maskwright.plans.export import elements, text_runs, wireframe
from maskwright.sources.pages import parse_html
from maskwright.vocab import Rules


def _one(units):
    """Breaks of a single block."""
    return np.append(1, np.zeros(max(len(units) - 1, 0), np.int64))[: len(units)]


def line_reasons(units):
    return spans.line_reasons(units, _one(units)).tolist()


def metric_units(units, breaks=None):
    return spans.metric_units(units, _one(units) if breaks is None else np.array(breaks)).tolist()


def protected(units, phrases, full):
    return spans.protected(units, phrases, full, _one(units)).tolist()


def test_line_reasons():
    assert line_reasons(["joe", "@", "shop", ".", "example"]) == ["email"] * 5
    assert line_reasons(["user_name"]) == [None] and line_reasons(["read-only"]) == [None] and line_reasons(["ne.jp"]) == [None]
    assert line_reasons(["03", "-", "5555", "-", "0199"]) == ["digit-run"] * 5
    assert line_reasons(["０３", "−", "５５５５"]) == ["digit-run"] * 3
    assert line_reasons(["k77@c.org"]) == ["digit-run"]  # the later pattern names the reason
    assert line_reasons(["03", " ", "5555"]) == ["digit-run", None, "digit-run"]
    assert line_reasons(["one.two.", "three", ""]) == ["email-frag", "email-frag", None]
    assert line_reasons([]) == []


@given(st.text("ab1.@-_+% ０Ａ", max_size=30))
@settings(max_examples=300, deadline=None)
def test_patterns_as_stated(text):
    """The fast search finds what the plain patterns find."""
    assert [m.span() for m in re.finditer(V.EMAIL, text)] == [tuple(x) for x in spans._emails(text).tolist()]
    assert [m.span() for m in re.finditer(V.EMAIL_HEAD, text)] == [m.span() for m in spans.HEAD.finditer(text)]
    want = [None] * len(text)
    for reason, pattern in V.LINE_PATTERNS:
        for m in re.finditer(pattern, spans.fold(text)):
            want[m.start() : m.end()] = [reason] * (m.end() - m.start())
    assert line_reasons(list(text)) == want


def test_metrics():
    for text in ("7.5%", "40ms", "-3件", "1,200回", "＋5人"):
        assert metric_units([text]) == [True]
    for text in ("5000件", "9,900円", "1999年", "09:45分", "3msec"):
        assert metric_units([text]) == [False]
    assert metric_units(["40", "ms"]) == [True, True] and metric_units(["x40", "ms"]) == [False, True]
    assert metric_units(["40", "ms"], [1, 1]) == [False, False]  # not over visual lines


def test_protected():
    assert protected(["鈴木", "花子", "殿"], ["鈴木花子"], False) == [True, True, False]
    assert protected(["有限", "会社", "Foo"], ["会社"], True) == [False, True, False] and protected(["限会", "社"], ["会社"], True) == [False, True]
    assert protected(["xy", ",", "z"], ["xyz"], False) == [True, False, True] and protected(["aaa"], ["aa"], True) == [True]
    assert protected(["a"], [], True) == [False]


def test_spans_of_blocks(spark):
    rows = [(1, ["12", "34"]), (2, None), (3, []), (4, [None, "joe@a", ".example", "\0"]), (5, ["56"])]
    df = spark.createDataFrame(rows, "b int, units array<string>").coalesce(1)
    got = {r.b: r.line_reason for r in with_spans(df, flags=("line_reason",)).collect()}
    # nothing reaches over blocks
    assert got == {1: ["digit-run"] * 2, 2: None, 3: [], 4: [None, "email", "email", None], 5: ["digit-run"]}
    assert with_spans(df).columns == ["b", "units", *spans.FLAGS]


def _token(surface, pos="名詞", d1="一般", d2="*"):
    return (surface, pos, d1, d2)


def test_name_runs(spark):
    blank, family = _token("　", "記号", "空白"), _token("大野", d1="固有名詞", d2="人名")
    cases = [
        ([_token("林"), _token("明")], ["kanji-run"] * 2),
        ([_token("林"), blank, _token("明"), blank], ["kanji-run"] * 3 + [None]),
        ([_token("札幌", d1="固有名詞", d2="地域"), _token("資料")], ["kanji-run"] * 2),
        ([_token("資料"), _token("検索", d1="サ変接続")], [None, None]),
        ([family, _token("すみれ"), _token("病院")], ["kana-name", "kana-name", None]),
        ([family, blank, _token("すみれ"), _token("すみれ")], ["kana-name"] * 3 + [None]),
        ([_token("札幌", d1="固有名詞", d2="地域"), _token("すみれ")], [None, None]),
        ([None, _token("林")], [None, None]),
        ([_token("林"), _token(" ", "名詞"), _token("明")], [None, None, None]),
        ([_token("林"), _token("明"), _token("広"), _token("資料")], [None] * 4),
    ]
    rows = [(b, i, t) for b, (tokens, _) in enumerate(cases) for i, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "b int, unit_idx int, token struct<surface_form:string,pos:string,pos_detail_1:string,pos_detail_2:string>")
    got = [r.name_run for r in with_name_runs(df, ["b"]).orderBy("b", "unit_idx").collect()]
    assert got == [x for _, expected in cases for x in expected]


def test_judge(spark):
    words = ["", "a@b", "３", "abcdefgh", "Save", "山田", "word", "!?", "　 ", None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [r.reason for r in df.select("i", T.judge(F.coalesce("w", F.lit("")))["reason"].alias("reason")).orderBy("i").collect()]
    assert got == ["empty", "at-mark", "digit", "long-text", "allowlist", "jp-name-like", "ascii-word", "unknown", "empty", "empty"]


def test_judge_token(spark):
    rows = [("県", "名詞", "接尾", "KNOWN"), ("札幌", "名詞", "固有名詞", "KNOWN"), ("八", "名詞", "数", "KNOWN"), ("☆☆", "記号", "*", "UNKNOWN"), ("ぴよ", "名詞", "一般", "UNKNOWN"), ("読む", "動詞", "自立", "KNOWN"), ("!", "記号", "一般", "KNOWN")]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t struct<surface_form:string,pos:string,pos_detail_1:string,word_type:string>")
    got = [r.reason for r in df.select("i", T.judge_token(F.col("t"))["reason"].alias("reason")).orderBy("i").collect()]
    assert got == ["address-suffix", "proper-noun", "number", "punct", "unknown-token", "pos:動詞", "punct"]


def test_cascade(spark):
    rows = [
        (0, "保存", None, None, "data", None, None), (1, "word", None, None, "label", None, None), (2, "word", None, True, None, None, None),
        (3, "word", None, None, None, 20.4, None), (4, "a1", None, None, "label", 20.0, None), (5, "a@b.co", "email", None, None, 1.0, None),
        (6, "5%", "digit-run", None, None, None, True), (7, "x", "email", None, None, None, True), (8, "word", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "unit_idx int, text string, line_reason string, label_kept boolean, semantic string, confidence double, unit_metric boolean")
    got = [(r.mask, r.reason) for r in decide(df).orderBy("unit_idx").collect()]
    assert got == [(True, "dom-data"), (False, "dom-label"), (False, "label"), (False, "noise(20)"), (True, "digit"), (True, "email"), (False, "unit-metric"), (True, "email"), (True, "ascii-word")]
    assert decide(df.withColumn("user_kept", F.lit(True))).where("mask").count() == 0


def test_runs_and_terms(spark):
    blocks = spark.createDataFrame([(1, ["03", "-", "5555", "鈴木", "foo@", "bar.com"])], "block_id int, units array<string>")
    runs = merge_runs(decide(spread_units(with_spans(blocks))), ["block_id"]).orderBy("start").collect()
    assert [(r.start, r.end, r.reason, r.text) for r in runs] == [(0, 2, "digit-run", "03-5555"), (3, 3, "jp-name-like", "鈴木"), (4, 5, "email", "foo@bar.com")]
    kept = decide(spread_units(with_spans(blocks, Rules(terms=("鈴木",)))))
    assert kept.where("text = '鈴木' AND mask").count() == 0 and kept.count() == 6


def test_html():
    page = """<head><title>t</title></head><nav>Home</nav><table><tr><th>Name</th><th>Mail</th></tr><tr><td>A <b>B</b></td><td>x@y.zz</td></tr></table>
    <input type=password value=secret><input value=shown><input type=hidden value=no><input type=submit value=Go><select><option>a<option selected>b</select><p hidden>no</p><script>no()</script>one<br>two"""
    rows = parse_html(page)
    assert [(r["text"], r["semantic"], r["table_id"], r["col"]) for r in rows] == [
        ("Home", "label", None, None), ("Name", "label", 0, 0), ("Mail", "label", 0, 1), ("A ", "data", 0, 0), ("B", "data", 0, 0), ("x@y.zz", "data", 0, 1),
        ("●●●", "data", None, None), ("shown", "data", None, None), ("Go", "label", None, None), ("b", "data", None, None), ("one", None, None, None), ("two", None, None, None),
    ]
    assert "secret" not in str(rows)


def test_edits(spark):
    rects = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 4.0, 20.0, 10.0, 10.0), (1, 3, 9.0, 40.0, 10.0, 10.0), (1, 4, 100.0, 0.0, 10.0, 10.0), (2, 1, 0.0, 0.0, 10.0, 10.0)]
    masks = spark.createDataFrame(rects, "page_id long, mask_id long, x double, y double, w double, h double")
    assert {r.mask_id for r in column_members(masks, masks.where("page_id = 1 AND mask_id = 1")).collect()} == {1, 2, 3}
    drag = spark.createDataFrame([(1, 5.0, 5.0, 5.0, 15.0)], "page_id long, x double, y double, w double, h double")
    assert {(r.page_id, r.mask_id) for r in bulk_unmask(masks, drag).collect()} == {(1, 2), (1, 3), (1, 4), (2, 1)}
    click = spark.createDataFrame([(1, 1, 10.0, 5.0)], "page_id long, click_id long, x double, y double")
    assert click_unmask(masks, click).count() == 4


def test_export_has_no_masked_text(spark):
    row = lambda x, t, b=0: {"page_id": 1, "x": float(x), "y": 0.0, "w": 10.0, "h": 10.0, "text": t, "block_id": b}
    texts = spark.createDataFrame([row(12, "b"), row(0, "a"), row(22.5, "c"), row(60, "d"), row(71, "e", 1)])
    assert [r.text for r in text_runs(texts).orderBy("x").collect()] == ["a bc", "d", "e"]
    runs = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 20.0, "seen", 0)], "page_id long, x double, y double, w double, h double, text string, block_id int")
    masks = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0, "digit-run", "03-5555")], "page_id long, x double, y double, w double, h double, reason string, text string")
    one, two = (wireframe(elements(masks, runs)).first().json for _ in range(2))
    assert one == two and "seen" in one and "digit-run" in one and "5555" not in one


def test_queries_run(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    for name, query in entry.queries().items():
        if not name.startswith("op") and name != "pipeline":
            assert query(spark, "/root/testdata/sf0.001").columns

import json

import pytest
from pyspark.sql import functions as F

from maskwright.functions.color import to_hex, with_color
from maskwright.functions.geometry import box
from maskwright.operators import edits, regions
from maskwright.operators.decide import decide, kept_of, masks_of
from maskwright.plans.export import decision_log, elements, wireframe
from maskwright.sources import phrases, units
from maskwright.sources.pages import parse_page
from maskwright.streaming.masking import mask_stream
from maskwright.vocab import Rules

BOX = "bbox struct<x0:double,y0:double,x1:double,y1:double>"
RECT = "x double, y double, w double, h double"


def test_runs_end_at_visual_lines(spark):
    rows = [(0, "joe@", (0.0, 0.0, 9.0, 10.0)), (1, "shop", (10.0, 1.0, 19.0, 11.0)), (2, ".org", (0.0, 20.0, 9.0, 30.0)), (3, "word", (10.0, 20.0, 19.0, 30.0))]
    df = spark.createDataFrame([(1, *r, "email" if r[0] < 3 else None) for r in rows], f"b int, unit_idx int, text string, {BOX}, line_reason string")
    got = [(r.ord, r.x, r.y, r.w, r.h, r.reason, r.text) for r in masks_of(decide(df), ["b"], Rules(scale=2.0, padding=1.0)).orderBy("ord").collect()]
    assert got == [(0, 4.0, 9.0, 6.5, 7.0, "ascii-word", "word"), (1, -1.0, -1.0, 11.5, 7.5, "email", "joe@shop"), (2, -1.0, 9.0, 6.5, 7.0, "email", ".org")]
    assert masks_of(decide(df.limit(0)), ["b"]).count() == 0


def test_units_of_tokens(spark):
    sym = lambda t, x: (t, (x, 0.0, x + 5, 10.0))
    words = [("ab", 90.0, (0.0, 0.0, 10.0, 10.0), [sym("a", 0.0), sym("b", 5.0)]), ("cd", 30.0, (10.0, 0.0, 20.0, 10.0), [sym("cd", 10.0)])]
    token = lambda s, at: (s, "名詞", "一般", "*", "KNOWN", at)
    rows = [(1, words, [token("abc", 1), token("d", 4), token("z", 9)]), (2, [("whole", 100.0, (0.0, 0.0, 1.0, 1.0), None)], []), (3, [], None)]
    df = spark.createDataFrame(rows, f"id int, words {units.WORDS}, tokens array<{units.TOKEN}>")
    got = [(r.id, r.unit_idx, r.text, r.bbox.x0, r.bbox.x1, r.confidence) for r in units.token_units(df).orderBy("id", "unit_idx").collect()]
    assert got == [(1, 0, "abc", 0.0, 15.0, 30.0), (1, 1, "d", 10.0, 15.0, 30.0), (2, 0, "whole", 0.0, 1.0, 100.0)]


def test_tokenizer_hook_and_routes(spark):
    payload = json.dumps({"blocks": [{"paragraphs": [{"lines": [{"words": [{"text": "hi", "confidence": 50, "bbox": {"x0": 0, "y0": 0, "x1": 4, "y1": 4}, "symbols": [{"text": "h"}, {"text": "i"}]}]}]}, {"lines": [{"words": []}]}]}]})
    df = spark.createDataFrame([(1, payload), (2, None), (3, "broken")], "page_id int, payload string")
    lines = units.read_ocr(df)
    assert [(r.page_id, r.block_id, r.line_id) for r in lines.orderBy("line_id").collect()] == [(1, 0, 0), (1, 0, 1)]
    tokens = units.with_tokens(lines, lambda t: [{"surface_form": c, "pos": "x", "word_position": i + 1} for i, c in enumerate(t)])
    assert [r.text for r in units.token_units(tokens).orderBy("unit_idx").collect()] == ["h", "i"]
    dom = spark.createDataFrame([(1, 5, 0)], "page_id int, block_id int, line_id int").withColumn("words", F.lit(None).cast(units.WORDS))
    assert [(r.page_id, r.route) for r in units.choose_route(dom, lines.unionByName(lines.withColumn("page_id", F.lit(4))), ["page_id"]).select("page_id", "route").distinct().orderBy("page_id").collect()] == [(1, "DOM"), (4, "OCR")]


def test_wrapped_text_and_visual_lines(spark):
    rows = [(1, 0, "a", (0.0, 0.0, 5.0, 10.0)), (1, 1, "b", (5.0, 4.0, 9.0, 14.0)), (1, 2, "c", (0.0, 10.0, 5.0, 20.0)), (1, 3, "d", (5.0, 30.0, 5.0, 40.0))]
    df = spark.createDataFrame(rows, f"id int, ord int, ch string, {BOX}")
    got = [r.piece for r in units.split_visual_lines(df, ["id"]).orderBy("ord").collect()]
    assert got == [0, 0, 1, 2]  # c shares 4 of its 10 with b
    assert [r.visual for r in units.with_visual_lines(df.withColumnRenamed("ord", "unit_idx"), ["id"]).orderBy("unit_idx").collect()] == [0, 0, 0, 1]


def test_colors(spark):
    known = {
        "rgb(1, 2, 3)": "#010203", "rgba(255, 0, 0, 0.5)": "#ff000080", "rgba(1, 2, 3, 0)": None, "#abc": "#aabbcc", "#A1B2C3": "#a1b2c3", "#11223380": "#11223380", "rgb(100% 0% 0% / 50%)": "#ff000080",
        "oklch(0.627955 0.257683 29.2339)": "#ff0000", "oklab(0.86644 -0.233888 0.179498)": "#00ff00", "lab(29.5683 68.2874 -112.0297)": "#0000ff", "lch(54.2905% 106.837 40.8571)": "#ff0000",
        "color(srgb 0.5 0 1)": "#8000ff", "color(display-p3 1 1 1)": "#ffffff", "oklch(1 0 none)": "#ffffff", "transparent": None, "nonsense(1)": None, "": None, None: None,
    }
    df = with_color(spark.createDataFrame([(k,) for k in known], "c string"), "c", "v")
    assert {r.c: r.h for r in df.select("c", to_hex(F.col("v")).alias("h")).collect()} == known


ELEMENT = f"page_id int, ord int, tag string, text string, {RECT}, screen_w double, screen_h double, framed boolean, background_color string, border_color string, border_width double, background_image boolean"


def _element(i, tag="div", w=30.0, h=30.0, bg=None, edge=None, text="", x=0.0, picture=False, framed=False):
    return (1, i, tag, text, x, 0.0, w, h, 100.0, 100.0, framed, bg, edge, 1.0 if edge else 0.0, picture)


def test_regions(spark):
    rows = [
        _element(0, "html", 100.0, 100.0, "rgb(200, 200, 200)"), _element(1, "div", 100.0, 100.0, "rgba(0, 0, 0, 0.5)"), _element(2, "div", 100.0, 100.0, "#fff", framed=True), _element(3, bg="#123456", edge="#000"),
        _element(4, w=5.0, bg="#123456"), _element(5, "img"), _element(6, "svg", 20.0, 20.0), _element(7, "span", 20.0, 20.0, text="\ue000 "), _element(8, "img", 90.0, 90.0, x=101.0), _element(9, "img", 7.0, 30.0),
        _element(10, "svg", 20.0, 20.0, picture=True), _element(11, "body", 60.0, 60.0, "#abcdef", "#000"),
    ]
    df = spark.createDataFrame(rows, ELEMENT)
    assert [(r.ord, r.reason, r.w) for r in regions.opaque_masks(df, ["page_id"], 2.0, 2.0).orderBy("ord").collect()] == [(5, "opaque(img)", 60.0)]
    icons = [(r.ord, r.kind) for r in regions.icons(df, ["page_id"]).orderBy("ord", "kind").collect()]
    assert icons == [(6, "svg"), (7, "glyph"), (10, "bg-image"), (10, "svg")]
    assert [r.ord for r in regions.icons(df, ["page_id"], limit=2).orderBy("ord").collect()] == [6, 7]
    assert [(r.ord, r.bg_color, r.border_color) for r in regions.decor(df, ["page_id"]).orderBy("ord").collect()] == [(3, "#123456", "#000000"), (11, "#abcdef", "#000000")]
    assert regions.page_ground(df.where("ord < 3"), ["page_id"]).first().page_background == "#646464"
    assert regions.page_ground(df.where("ord = 5"), ["page_id"]).first().page_background == "#ffffff"


def test_gestures_and_replay(spark):
    strokes = [(1, 1, 5.0, 5.0, 6.0, 6.0, False, False), (1, 2, 50.0, 0.0, 60.0, 9.0, False, False), (1, 3, 50.0, 50.0, 51.0, 59.0, False, False), (1, 4, 0.0, 18.0, 30.0, 35.0, False, True), (1, 5, 105.0, 5.0, 105.0, 6.0, True, False), (2, 1, 0.0, 0.0, 9.0, 9.0, False, False)]
    pointer = spark.createDataFrame(strokes, "page_id long, seq long, x0 double, y0 double, x1 double, y1 double, alt boolean, shift boolean")
    log = edits.gestures(pointer)
    assert [(r.page_id, r.seq, r.edit) for r in log.orderBy("page_id", "seq").collect()] == [(1, 1, "click"), (1, 2, "add"), (1, 4, "bulk"), (1, 5, "column"), (2, 1, "add")]
    masks = [(1, 0, 0.0, 0.0, 10.0, 10.0, "auto", "digit", "12"), (1, 1, 0.0, 0.0, 10.0, 10.0, "auto", "digit", "34"), (1, 2, 0.0, 20.0, 10.0, 10.0, "manual", "manual", None), (1, 3, 100.0, 0.0, 10.0, 10.0, "auto", "digit", "56"), (1, 4, 104.0, 80.0, 10.0, 10.0, "auto", "digit", "78")]
    df = spark.createDataFrame(masks, f"page_id long, ord long, {RECT}, source string, reason string, text string")
    got = {(r.page_id, r.state, r.ord, r.text) for r in edits.replay(df, log).collect()}
    assert got == {(1, "mask", 0, "12"), (1, "mask", 5, None), (1, "revealed", 1, "34"), (1, "revealed", 3, "56"), (1, "revealed", 4, "78"), (2, "mask", 0, None)}
    first = {(r.state, r.text) for r in edits.replay(df, log.where("seq = 1 AND page_id = 1")).collect() if r.state == "offered"}
    assert first == {("offered", "34")} and edits.replay(df.limit(0), log.limit(0)).count() == 0


def test_phrase_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text('["b", " a ", "", "b"]')
    (tmp_path / "b.json").write_text('{"version": 1, "terms": ["c"]}')
    found = phrases.read_phrases(spark, str(tmp_path))
    own = spark.createDataFrame([(0, "a"), (1, None), (2, "　d　")], "ord int, term string")
    assert [r.term for r in phrases.merge_phrases(own, found.where("term != 'c'"), found.where("term = 'c'")).orderBy("ord").collect()] == ["a", "d", "b", "c"]
    assert json.loads(phrases.phrases_json(own.where("ord < 1")).first().value) == {"version": 1, "terms": ["a"]}
    replayed = spark.createDataFrame([(2, "offered", "e"), (1, "offered", "a"), (1, "revealed", "x")], "page_id long, state string, text string")
    assert phrases.terms_of(phrases.register_offered(own, replayed)) == ("a", "d", "e")
    with pytest.raises(ValueError):
        phrases.terms_of(own, 1)
    for bad in ('{"terms": "x"}', "[1]", '"x"', "no json", '{"a": []}', '["a", 1]'):
        with pytest.raises(Exception, match="list of phrases"):
            phrases.parse_phrases(spark.createDataFrame([(bad,)], "value string")).collect()


def test_drawing(spark):
    rect = lambda i, *more: (1, i, 0.0, 10.0 * i, 10.0, 10.0, *more)
    masks = spark.createDataFrame([rect(0, "digit", "12-34", "td", 0, 1), rect(1, "opaque(img)", None, None, None, 2), rect(2, None, None, "", 3, None)], f"page_id int, ord int, {RECT}, reason string, text string, kind string, table_id int, col int")
    texts = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, "seen", 4)], f"page_id int, {RECT}, text string, block_id int")
    revealed = spark.createDataFrame([rect(0, "digit", "99"), rect(1, "digit", None)], f"page_id int, ord int, {RECT}, reason string, text string")
    decor = spark.createDataFrame([rect(0, "#ffffff", None)], f"page_id int, ord int, {RECT}, bg_color string, border_color string")
    icons = spark.createDataFrame([rect(0, "svg", "data:1"), rect(1, "svg", None)], f"page_id int, ord int, {RECT}, kind string, data_url string")
    page = json.loads(wireframe(elements(masks, texts, revealed, decor, icons, 2.0)).first().json)
    assert [e["id"] for e in page["elements"]] == ["m2g-d-0000", "m2g-i-0002", "m2g-t-0003", "m2g-t-0004", "m2g-m-0005", "m2g-m-0006", "m2g-m-0007"]
    assert [e["customData"]["m2g"]["role"] for e in page["elements"]] == ["decor", "icon", "text", "revealed", "masked", "masked", "masked"]
    meta = [e["customData"]["m2g"] for e in page["elements"]]
    assert meta[4] == {"v": 1, "role": "masked", "reason": "digit", "kind": "td", "tableId": 0, "col": 1} and meta[5] == {"v": 1, "role": "masked", "reason": "opaque(img)"} and meta[6] == {"v": 1, "role": "masked", "reason": "manual"}
    assert page["files"]["m2g-f-0001"]["dataURL"] == "data:1" and page["elements"][1]["fileId"] == "m2g-f-0001"
    assert page["elements"][2]["fontSize"] == 9 and page["elements"][2]["groupIds"] == ["block-4"] and page["elements"][0]["groupIds"] == []
    assert page["elements"][4]["fillStyle"] == "hachure" and page["elements"][5]["fillStyle"] == "cross-hatch" and page["elements"][2]["width"] == 5.0
    assert "12-34" not in json.dumps(page) and page["appState"]["viewBackgroundColor"] == "#ffffff"


def test_decision_log(spark):
    df = spark.createDataFrame([(1, 0, 0, "Save", (0.0, 0.0, 1.0, 1.0)), (1, 0, 1, "Bob", (2.0, 0.0, 3.0, 1.0))], f"page_id int, block_id int, unit_idx int, text string, {BOX}")
    decided = decide(df)
    keys = ["page_id", "block_id"]
    log = json.loads(decision_log(decided, masks_of(decided, keys), kept_of(decided, keys)).first().json)
    assert log == {"route": "DOM", "summary": {"塗:ascii-word": 1, "残:allowlist": 1}, "masks": [{"text": "Bob", "reason": "ascii-word", "source": "auto"}], "kept": [{"text": "Save", "reason": "allowlist"}], "decisions": ["Save=残:allowlist", "Bob=塗:ascii-word"]}


def test_form_values_and_roles():
    page = parse_page("""<p>Mr <b>Fox</b></p><select><option disabled>x<option>one<option>two</select><select multiple><option>a<option selected>b<option selected label=L>c</select><select multiple><option>no</select>
        <textarea> two\nlines</textarea><input type=EMAIL value=e><input value=v><input type=password><output>5</output><div role=row><span role=rowheader>h</span><i>c</i></div>
        <svg><text>no</text></svg><iframe width=50 height=20></iframe><object>no</object><td hidden>no</td>""")
    assert [(r["text"], r["semantic"], r["kind"]) for r in page.rows] == [
        ("Mr ", None, None), ("Fox", None, None), ("one", "data", "select"), ("b L", "data", "select"), (" two\nlines", "data", "textarea"), ("e", "data", "input:email"), ("v", "data", "input:text"), ("5", "data", "output"),
        ("h", "label", "rowheader"), ("c", "data", "row"),
    ]
    assert page.rows[0]["block_id"] == page.rows[1]["block_id"] and [o["tag"] for o in page.opaque] == ["svg", "frame", "frame"]
    assert [(r["table_id"], r["col"]) for r in page.rows[-2:]] == [(0, 0), (0, 1)] and page.opaque[1]["w"] == 50.0


def test_stream_masks_keep_case(spark, tmp_path):
    spark.createDataFrame([("Ann A1B2 ＡＢ１２ Joe@Shop.Org 03-5555 x",), (None,)], "text string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
    query = mask_stream(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(60)
    assert {r.masked for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"Ann A1B2 ＡＢ█ █ █ x", None}


def test_box(spark):
    assert spark.range(1).select(box(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("b")).first().b.x1 == 3.0

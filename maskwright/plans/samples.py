"""Screens, morphemes, pages and strokes built by rule from the tables, as no table holds any.

Each rule is simple arithmetic on ids and places, so that SQL can state the same rows. Words are real ones; labels,
measures, addresses and numbers stand between them, cut into pieces as recognised text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..functions.text import once

#: Texts that stand in place of words, by ``(3 * conv_id + 5 * turn + unit_idx) % SCREEN_CYCLE``.
SCREEN_TEXTS = {3: "Save", 4: ":", 7: "+12", 8: "件", 11: "090-1234-", 12: "5678", 15: "ann@", 16: "mail.example.org", 20: "99.95%", 23: "検索", 25: "顧客:", 27: "★"}
SCREEN_CYCLE = 29
#: Units of a screen's row; their distance and size.
ROW_UNITS, STEP_X, STEP_Y, UNIT_W, UNIT_H = 8, 80, 20, 76, 14
#: Phrases of the screens' user.
SCREEN_TERMS = ("5678", "the and")
#: Morphemes: surface, part of speech, two details, known or not.
MORPHEMES = (
    ("林", "名詞", "一般", "*", "KNOWN"), ("明", "名詞", "一般", "*", "KNOWN"), ("　", "記号", "空白", "*", "KNOWN"), ("大野", "名詞", "固有名詞", "人名", "KNOWN"), ("すみれ", "名詞", "一般", "*", "KNOWN"),
    ("病院", "名詞", "一般", "*", "KNOWN"), ("は", "助詞", "係助詞", "*", "KNOWN"), ("市", "名詞", "接尾", "地域", "KNOWN"), ("札幌", "名詞", "固有名詞", "地域", "KNOWN"), ("三", "名詞", "数", "*", "KNOWN"),
    ("。", "記号", "句点", "*", "KNOWN"), ("Zkw", "名詞", "一般", "*", "UNKNOWN"), ("☆", "記号", "一般", "*", "UNKNOWN"), ("検索", "名詞", "サ変接続", "*", "KNOWN"), ("7", "名詞", "数", "*", "UNKNOWN"),
    ("資料", "名詞", "一般", "*", "KNOWN"), ("管理", "名詞", "サ変接続", "*", "KNOWN"), ("x@", "名詞", "一般", "*", "UNKNOWN"), ("若い", "形容詞", "自立", "*", "KNOWN"), ("インターフェース", "名詞", "一般", "*", "KNOWN"),
    ("さん", "名詞", "接尾", "人名", "KNOWN"), ("広", "名詞", "一般", "*", "KNOWN"),
)
#: Morphemes of a document's line: number ``i`` is ``MORPHEMES[(doc_id * 7 + i * i * 3 + i * (doc_id % 11)) % len(MORPHEMES)]``.
LINE_MORPHEMES = 24


def screen_units(conversations: DataFrame) -> DataFrame:
    """Each message as a block of a screen: ``conv_id, turn, unit_idx, text, bbox, confidence, semantic, kind, table_id, col``."""
    words = F.regexp_extract_all("text", F.lit("([^ \\t\\r\\n\\x0B\\f]+)"), F.lit(1))
    rows = conversations.select("conv_id", "turn", F.posexplode(words).alias("unit_idx", "word"))
    k, s = F.col("unit_idx"), F.col("conv_id") * 3 + F.col("turn") * 5 + F.col("unit_idx")
    text = F.col("word")
    for at, said in SCREEN_TEXTS.items():
        text = F.when(s % SCREEN_CYCLE == at, said).otherwise(text)
    x, y = (k % ROW_UNITS) * STEP_X, F.floor(k / ROW_UNITS) * STEP_Y
    semantic = F.when(s % 31 < 4, "label").when((s % 31).between(10, 14), "data")
    rows = once(rows, text=text, semantic=semantic)
    semantic = F.col("semantic")
    return rows.select(
        "conv_id", "turn", "unit_idx", "text", box(x, y, x + UNIT_W, y + UNIT_H).alias("bbox"), F.when(s % 7 == 5, 12.5).otherwise(90.0).alias("confidence"), "semantic",
        F.when(semantic == "label", "th").when(semantic == "data", "td").alias("kind"), F.when(semantic.isNotNull(), F.col("turn").cast("int")).alias("table_id"), F.when(semantic.isNotNull(), (k % 4).cast("int")).alias("col"),
    )


def screen_lines(conversations: DataFrame) -> DataFrame:
    """The rows of ``screen_units`` as one screen line a block, with a box for each character: ``conv_id, turn, words``."""
    units = screen_units(conversations)
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    width = F.lit(float(UNIT_W)) / F.size(chars)
    left = F.col("bbox.x0")
    symbols = F.transform(chars, lambda c, i: F.struct(c.alias("text"), box(left + width * i, F.col("bbox.y0"), left + width * (i + 1), F.col("bbox.y1")).alias("bbox")))
    word = F.struct("unit_idx", F.struct("text", "confidence", "bbox", symbols.alias("symbols")).alias("w"))
    lines = units.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(word), lambda a, b: (a["unit_idx"] - b["unit_idx"]).cast("int")).alias("ws"))
    return lines.select("conv_id", "turn", F.transform("ws", lambda w: w["w"]).alias("words"))


#: Glyphs of a row, its distance, and the screen's size.
GLYPHS, GLYPH_W, PITCH, GLYPH_SCREEN = 40, 8, 10, (300, 120)


def set_texts(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, glyphs``: each message set in rows of ``GLYPHS``, every thirteenth glyph without width; rows overlap a little."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")

    def glyph(c: Column, i: Column) -> Column:
        x, y = (i % GLYPHS) * GLYPH_W, F.floor(i / GLYPHS) * PITCH + i % 3
        return F.struct(c.alias("ch"), box(x, y, x + F.when(i % 13 == 0, 0).otherwise(GLYPH_W), y + 12 + i % 2 * 2).alias("bbox"))

    return conversations.select("conv_id", "turn", F.transform(chars, glyph).alias("glyphs"))


def ocr_pages(conversations: DataFrame) -> DataFrame:
    """``conv_id, payload``: each conversation's screens as recognised text in JSON, a block for each message."""
    words = screen_lines(conversations).select("conv_id", "turn", F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["confidence"].alias("confidence"), w["bbox"].alias("bbox"))).alias("words"))
    line = F.struct(F.array(F.struct("words")).alias("lines"))
    block = F.struct("turn", F.struct(F.array(line).alias("paragraphs")).alias("b"))
    pages = words.groupBy("conv_id").agg(F.collect_list(block).alias("bs"))
    ordered = F.array_sort("bs", lambda a, b: F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0))
    return pages.select("conv_id", F.to_json(F.struct(F.transform(ordered, lambda x: x["b"]).alias("blocks"))).alias("payload"))


def halves(text: str) -> list[dict]:
    """A stand-in for a tokenizer: pieces of at most four characters, all unknown nouns."""
    cuts = range(0, len(text), 4)
    return [{"surface_form": text[i : i + 4], "pos": "名詞", "pos_detail_1": "一般", "pos_detail_2": "*", "word_type": "UNKNOWN", "word_position": i + 1} for i in cuts]


def morpheme_units(documents: DataFrame) -> DataFrame:
    """``doc_id, unit_idx, text, token`` and a place: a line of morphemes for each document."""
    fields = ("surface_form", "pos", "pos_detail_1", "pos_detail_2", "word_type")
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(m, fields, strict=True))) for m in MORPHEMES))
    i, d = F.col("unit_idx"), F.col("doc_id")
    rows = documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(LINE_MORPHEMES - 1))).alias("unit_idx"))
    rows = once(rows, token=F.element_at(table, ((d * 7 + i * i * 3 + i * (d % 11)) % len(MORPHEMES)).cast("int") + 1))
    return rows.select("doc_id", "unit_idx", F.col("token.surface_form").alias("text"), "token", F.when((d + i) % 13 == 0, "label").when((d + i) % 17 == 0, "data").alias("semantic"), F.when((d + i) % 9 == 0, 20.0).otherwise(95.0).alias("confidence"))


def _escaped(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def form_pages(documents: DataFrame) -> DataFrame:
    """``page_id, html``: a page of each document with a menu, a table, a form and a grid, filled with its first words."""
    words = F.regexp_extract_all("text", F.lit("([^ \\t\\r\\n\\x0B\\f]+)"), F.lit(1))
    word = lambda i: _escaped(F.coalesce(F.try_element_at(words, F.lit(i)), F.lit("none")))
    parts = [
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>", word(1), "</a></nav><h1>", word(2), "</h1><table><tr><th>Name</th><th>", word(3), "</th></tr><tr><td>", word(4),
        "</td><td>x<b>", word(5), '</b></td></tr></table><form><label>Mail</label><input type="email" value="', word(6), '"><input type=password value="', word(7), '"><input type=hidden value=h><input type=submit value="',
        word(8), '"><select><option>', word(9), "</option><option>", word(10), "</option></select><select><option>", word(9), "</option><option selected>", word(10), "</option></select><textarea>", word(11),
        '</textarea></form><div role=grid><div role=row><div role=columnheader>Total</div><div>', word(12), "</div></div><div role=row><div role=cell>", word(13), "</div><div>", word(14), '</div></div></div><p hidden>',
        word(1), "</p><script>var a = 1</script><img width=40 height=30><p>", word(15), "<br>", word(16), "</p></body></html>",
    ]
    return documents.select(F.col("doc_id").alias("page_id"), F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("html"))


#: Sheets of ``composed_pages``: of ancestors, children, ids against classes, media, boxes that are not there.
COMPOSED_STYLE = ".gone .deep{display:none}.card>b{display:block}.off{visibility:hidden}#k .way{display:none}i.way{display:inline}@media print{p{display:none}}.row{display:contents}"


def composed_pages(documents: DataFrame) -> DataFrame:
    """``page_id, html``: a page of each document with shadow trees, slots, a frame's own document, and style sheets that hide."""
    words = F.regexp_extract_all("text", F.lit("([^ \\t\\r\\n\\x0B\\f]+)"), F.lit(1))
    word = lambda i: _escaped(F.coalesce(F.try_element_at(words, F.lit(i)), F.lit("none")))
    parts = [
        f"<html><head><style>{COMPOSED_STYLE}</style></head><body><nav data-check=keep>", word(1), "</nav>",
        "<div class=card id=k><template shadowrootmode=open><style>i{display:none}</style><h2><slot name=head>none</slot></h2><table><tr><td><slot></slot></td></tr></table><i>never</i></template><span slot=head>",
        word(2), "</span>", word(3), "<i>", word(4), "</i><i class=way>no</i></div>",
        "<table><tr><th data-check=keep>Name</th><th>", word(5), "</th></tr><tr><td data-check=mask>", word(6), "</td><td><x-sum><template shadowrootmode=closed><b>", word(7), "</b></template>lost</x-sum></td></tr></table>",
        "<div class=gone>", word(8), "<p class=deep>", word(9), "</p></div><div class=card>", word(10), "<b>", word(11), "</b></div><p class=off>", word(9), '<span style="visibility:visible">x</span></p><p>', word(12), "<span class=way>",
        word(13), "</span></p><div role=row class=row><div role=columnheader>Total</div><div data-check=mask>", word(14), '</div></div><table><tr><td><iframe srcdoc="<nav>', _escaped(word(15)), "</nav><p>", _escaped(word(16)),
        '</p>"></iframe></td></tr></table></body></html>',
    ]
    return documents.select(F.col("doc_id").alias("page_id"), F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("html"))


def opaque_pages(documents: DataFrame) -> DataFrame:
    """``page_id, html``: a page of each document with elements that cannot be read, of sizes by its number, some of them hidden."""
    n = F.col("doc_id")
    side = lambda k: (n * k % 97).cast("string")
    parts = [
        "<style>.off{display:none}.ghost{opacity:0}</style><p>a<img width=", side(3), " height=", side(5), "></p><div class=off><canvas width=9></canvas></div><svg width=", side(7), "><text>no</text></svg><video height=2.5></video>",
        "<iframe src=x width=", side(11), ' height=10></iframe><iframe srcdoc="<img width=', side(13), '><embed>"></iframe><picture class=ghost></picture><x-a><template shadowrootmode=open><object width=', side(17),
        "></object></template><img></x-a>", F.when(n % 3 == 0, "<frame width=1 height=1>").otherwise(""),
    ]
    return documents.select(n.alias("page_id"), F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("html"))


#: Documents whose elements make one crowded page.
CROWD = 50


def screen_elements(documents: DataFrame) -> DataFrame:
    """Elements of a screen of 1000 by 800 for each document, with places, tags and colours."""
    d, i = F.col("doc_id"), F.col("ord")
    rows = documents.select(d.alias("page_id"), "doc_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("ord"))
    v = (d * 13 + i * 7) % 1000
    tag = F.element_at(F.array(*map(F.lit, ("div", "img", "svg", "span", "frame", "body"))), ((d + i) % 6).cast("int") + 1)
    colors = ("rgb(10, 20, 30)", "rgba(200, 100, 0, 0.5)", "rgba(0, 0, 0, 0)", "#abc", "#11223344", "transparent")
    color = lambda n: F.element_at(F.array(*map(F.lit, colors)), (n % len(colors)).cast("int") + 1)
    made = rows.select(
        "page_id", "ord", tag.alias("tag"), F.when((d + i) % 19 == 0, "\ue001").otherwise("a").alias("text"), (v - 40).cast("double").alias("x"), ((v * 3) % 900 - 30).cast("double").alias("y"),
        (4 + (v * 5) % 90).cast("double").alias("w"), (4 + (v * 11) % 70).cast("double").alias("h"), F.lit(1000.0).alias("screen_w"), F.lit(800.0).alias("screen_h"), ((d + i) % 23 == 0).alias("framed"),
        color(d + i).alias("background_color"), color(d + i * 2 + 1).alias("border_color"), (i % 3).cast("double").alias("border_width"), ((d + i) % 5 == 0).alias("background_image"),
    )
    return once(made, **{c: F.col(c) for c in made.columns})

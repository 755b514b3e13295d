from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import text as T
from maskwright.operators.decide import decide, merge_runs
from maskwright.operators.names import with_name_runs
from maskwright.operators.spans import spread_units, with_spans
from maskwright.plans import queries as Q


def test_all_labels_of_the_dictionary(spark):
    assert len(V.LABELS) == len(set(V.LABELS)) == 205 and "send" not in V.LABELS
    words = ["list", "View", "ＵＳＥＲ", "id", "no", "url", "氏名", "住所", "アクティブ", "send"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [r.reason for r in df.select("i", T.judge(F.col("w"))["reason"].alias("reason")).orderBy("i").collect()]
    assert got == ["allowlist"] * 9 + ["ascii-word"]


def test_cascade_keeps_labels_on_documents_and_pages(spark, tmp_path):
    spark.createDataFrame([(1, "Name: Bob, Sync Status\nfilter, 5% a.b.c@d.ee")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.block_id, r.unit_idx): (r.text, r.mask, r.reason) for r in Q.cascade_units(spark, str(tmp_path)).collect()}
    assert got == {
        (0, 0): ("Name:", False, "label"), (0, 2): ("Bob,", True, "unknown"), (0, 4): ("Sync", False, "allowlist"), (0, 6): ("Status", False, "allowlist"),
        (1, 0): ("filter,", False, "label"), (1, 2): ("5%", False, "unit-metric"), (1, 4): ("a.b.c@d.ee", True, "email"),
    }
    page = "<p>Account overview:<br>Bob</p><div>joe.<br>fox@<br>b.com</div><table><tr><td>list,</td></tr></table>"
    spark.createDataFrame([(7, page)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = Q.html_decide(spark, str(tmp_path)).orderBy("line_id").collect()
    assert [(r.line_id, r.mask, r.reason) for r in rows] == [(0, False, "label"), (1, True, "ascii-word"), (2, True, "email"), (3, True, "email"), (4, True, "email"), (5, True, "unknown")]
    assert Q.cascade_summary(spark, str(tmp_path)).count() == 5


def test_name_runs_reach_the_decision(spark):
    token = lambda s, p="名詞", d1="一般", d2="*": (s, p, d1, d2, "KNOWN")
    units = ["林", "明", "は", "大野", "すみれ"]
    tokens = [token("林"), token("明", "形容詞", "自立"), token("は", "助詞", "係助詞"), token("大野", d1="固有名詞", d2="人名"), token("すみれ")]
    kind = "array<struct<surface_form:string,pos:string,pos_detail_1:string,pos_detail_2:string,word_type:string>>"
    df = spark.createDataFrame([(1, units, tokens), (2, ["Bob"], None)], f"block_id int, units array<string>, tokens {kind}")
    decided = decide(with_name_runs(spread_units(with_spans(df)), ["block_id"]))
    got = [(r.mask, r.reason) for r in decided.orderBy("block_id", "unit_idx").collect()]
    assert got == [(True, "kanji-run")] * 2 + [(False, "pos:助詞"), (True, "proper-noun"), (True, "kana-name"), (True, "ascii-word")]
    assert [r.text for r in merge_runs(decided, ["block_id"]).where("reason = 'kanji-run'").collect()] == ["林明"]

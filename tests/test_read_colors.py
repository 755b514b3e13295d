"""Colours are read natively, and only where icons need to know how many boxes a page has."""

from pyspark.sql import functions as F

from maskwright.functions.color import to_hex, with_color
from maskwright.operators.regions import DECOR_LIMIT, icons

TEXTS = ["#abc", " #ABCD ", "#11223344", "#12345", "#ggg", "rgb(1, 2, 3)", "rgb(10% none 3/50%)", "color(srgb 1 0 0)", "color(display-p3 0 1 0)", "red", "transparent", "rgba(0,0,0,0)", "", "(", "hsl(1 2 3)", None]
WANT = ["#aabbcc", "#aabbccdd", "#11223344", None, None, "#010203", "#1a000380", "#ff0000", "#00ff00", None, None, None, None, None, None, None]


def test_colors_without_interpreted_steps(spark):
    read = with_color(spark.createDataFrame(list(enumerate(TEXTS)), "n int, c string"), "c", "color")
    assert [r.h for r in read.orderBy("n").select(to_hex(F.col("color")).alias("h")).collect()] == WANT
    assert "lambdafunction" not in read._jdf.queryExecution().optimizedPlan().toString()


def test_icons_of_small_and_crowded_pages(spark):
    """A picture behind an element counts until the page has all its boxes; a small page's colours are not asked for."""
    rows = spark.range(DECOR_LIMIT + 3).selectExpr("explode(if(id < 5, array(1, 2), array(2))) AS page_id", "int(id) AS ord")
    made = rows.selectExpr(
        "page_id", "ord", "'div' AS tag", "'a' AS text", "1D AS x", "1D AS y", "10D AS w", "10D AS h", "1000D AS screen_w", "800D AS screen_h", "false AS framed",
        "'#123456' AS background_color", "'#abc' AS border_color", "1D AS border_width", "true AS background_image",
    )
    found = icons(made, ["page_id"], limit=10**6)
    assert {r.page_id: r["count"] for r in found.groupBy("page_id").count().collect()} == {1: 5, 2: DECOR_LIMIT}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_plain") < plan.index("_many")  # printed from the last step to the first

"""Wide rows reach Python in small batches."""

import pyarrow as pa

from maskwright.operators.spans import with_spans
from maskwright.sources.pages import ROWS, page_lines

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_batches_of_wide_rows(spark):
    """A task of many blocks hands them on a thousand at a time; what the user has set stays."""
    spark.conf.unset(NAME)
    blocks = spark.range(3000).selectExpr("id", "array('a', 'b') AS units").coalesce(1)
    sizes = lambda df: df.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    try:
        spanned = with_spans(blocks, flags=("unit_metric",))
        assert max(r.n for r in sizes(blocks).collect()) <= 1000 and spanned.count() == 3000
        spark.conf.set(NAME, "77")
        with_spans(blocks)
        assert spark.conf.get(NAME) == "77"
    finally:
        spark.conf.unset(NAME)


def test_many_pages_in_one_task(spark):
    pages = spark.range(ROWS).selectExpr("id AS page_id", "if(id % 5 = 0, NULL, concat('<p>a', id, '</p><p>b</p>')) AS html").coalesce(1)
    got = page_lines(pages).collect()
    want = [(i, n, t) for i in range(ROWS) if i % 5 for n, t in enumerate((f"a{i}", "b"))]
    assert sorted((r.page_id, r.line_id, r.text) for r in got) == want


def test_batches_of_large_rows(spark):
    """Pages of a megabyte each are handed on a few at a time; what the user has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    pages = spark.range(60).selectExpr("id AS page_id", "concat('<p>a</p><!--', repeat('abcdefgh', 125000), '-->') AS html").coalesce(1)
    sizes = lambda df: df.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    spark.conf.unset(name)
    try:
        lines = page_lines(pages)
        assert max(r.n for r in sizes(pages).collect()) <= 10 and lines.count() == 60
        spark.conf.set(name, "123456b")
        page_lines(pages)
        assert spark.conf.get(name) == "123456b"
    finally:
        spark.conf.unset(name)

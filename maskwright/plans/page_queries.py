"""Registered queries over pages as they are shown, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as T
from ..operators.decide import decide
from ..operators.spans import spread_units, with_spans
from ..sources.pages import page_blocks, page_lines, page_opaque
from ..sources.units import spread
from . import oracle, samples


def table_link(lines: DataFrame) -> DataFrame:
    """Data cells with the text of their column's header."""
    heads = lines.where(F.col("kind").isin("th", "columnheader")).groupBy("page_id", "table_id", "col").agg(F.min_by("text", "line_id").alias("header"))
    return lines.where("semantic = 'data' AND table_id IS NOT NULL").join(heads, ["page_id", "table_id", "col"], "left").select("page_id", "line_id", "table_id", "col", "text", "header")


def decide_pages(pages: DataFrame) -> DataFrame:
    """The lines of pages with their decision."""
    units = spread_units(with_spans(page_blocks(pages), flags=("line_reason", "label_kept")), along=("line",))
    # patterns and labels reach over a block, measures over one line
    units = units.select("*", "line.*").drop("line").withColumn("unit_metric", T.unit_is_metric(F.col("text")))
    return decide(units).select("page_id", "block_id", "line_id", "semantic", "kind", "table_id", "col", "mask", "reason")


def _pages(spark, sf_dir):
    return samples.composed_pages(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def composed_lines(spark, sf_dir):
    """Lines of pages with shadow trees, slots, frames and style sheets."""
    return page_lines(_pages(spark, sf_dir), checks=True)


def composed_table_link(spark, sf_dir):
    """Cells, some of them in shadow trees, with their headers."""
    return table_link(page_lines(_pages(spark, sf_dir)))


def composed_decide(spark, sf_dir):
    return decide_pages(_pages(spark, sf_dir))


def opaque_elements(spark, sf_dir):
    """What cannot be read of pages: pictures, drawings and frames, in order; none that is hidden."""
    return page_opaque(samples.opaque_pages(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def page_coverage(spark, sf_dir):
    """Leaks and over-masking against what the pages themselves expect of their texts."""
    pages = _pages(spark, sf_dir)
    expected = page_lines(pages, checks=True).where("check IS NOT NULL").select("page_id", "line_id", "check")
    both = decide_pages(pages).join(expected, ["page_id", "line_id"])
    return both.groupBy("check").agg(F.count_if((F.col("check") == "mask") != F.col("mask")).alias("violations"), F.count("*").alias("n"))


# -- SQL ------------------------------------------------------------------------------------------------------------
_WORDS = "list_transform(range(1, 17), lambda i: coalesce(regexp_extract_all(text, '[^ \\t\\r\\n\\x0B\\f]+')[i], 'none'))"
_LINES = f"""WITH w AS (SELECT doc_id AS page_id, {_WORDS} AS w FROM documents),
    lines AS (SELECT page_id, unnest([0, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12, 13]) AS block_id, unnest(range(17)) AS line_id,
        unnest(['label', NULL, NULL, NULL, 'label', 'label', 'data', 'data', NULL, NULL, NULL, NULL, NULL, 'label', 'data', 'label', NULL]) AS semantic,
        unnest(['nav', NULL, NULL, NULL, 'th', 'th', 'td', 'td', NULL, NULL, NULL, NULL, NULL, 'columnheader', 'row', 'nav', NULL]) AS kind,
        unnest([NULL, NULL, NULL, NULL, 0, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, 1, 1, NULL, NULL]) AS table_id,
        unnest([NULL, NULL, NULL, NULL, 0, 1, 0, 1, NULL, NULL, NULL, NULL, NULL, 0, 1, NULL, NULL]) AS col,
        unnest([w[1], w[2], w[3], w[4], 'Name', w[5], w[6], w[7], w[8], w[10], w[11], w[12], w[13], 'Total', w[14], w[15], w[16]]) AS text,
        unnest(['keep', NULL, NULL, NULL, 'keep', NULL, 'mask', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'mask', NULL, NULL]) AS "check" FROM w)
    SELECT page_id, CAST(block_id AS INT) AS block_id, CAST(line_id AS INT) AS line_id, semantic, kind, CAST(table_id AS INT) AS table_id, CAST(col AS INT) AS col, text, "check" FROM lines"""
_UNITS = f"""SELECT page_id AS k1, block_id AS k2, 0 AS k3, CAST(row_number() OVER (PARTITION BY page_id, block_id ORDER BY line_id) - 1 AS INT) AS unit_idx, text, line_id AS vis, semantic, NULL::DOUBLE AS confidence,
    line_id, kind, table_id, col, "check" FROM ({_LINES})"""
_DECIDED = oracle.spans(_UNITS, labels=V.LABELS, metric=True) + oracle.cascade()

QUERIES = {f.__name__: f for f in (composed_lines, composed_table_link, composed_decide, page_coverage, opaque_elements)}
ORACLE_SQL = {
    "composed_lines": _LINES,
    "composed_table_link": f"""WITH l AS ({_LINES}) SELECT c.page_id, c.line_id, c.table_id, c.col, c.text, h.text AS header FROM l c
        LEFT JOIN l h ON h.page_id = c.page_id AND h.table_id = c.table_id AND h.col = c.col AND h.kind IN ('th', 'columnheader') WHERE c.semantic = 'data' AND c.table_id IS NOT NULL""",
    "composed_decide": _DECIDED + " SELECT k1 AS page_id, k2 AS block_id, line_id, semantic, kind, table_id, col, mask, reason FROM decided",
    "page_coverage": _DECIDED + """ SELECT "check", count(*) FILTER (("check" = 'mask') <> mask) AS violations, count(*) AS n FROM decided WHERE "check" IS NOT NULL GROUP BY 1""",
}
_SIDE = lambda k: f"(doc_id * {k} % 97)::DOUBLE"
ORACLE_SQL["opaque_elements"] = f"""WITH listed AS (SELECT doc_id AS page_id, unnest(['img', 'svg', 'video', 'frame', 'img', 'frame', 'frame'] || CASE WHEN doc_id % 3 = 0 THEN ['frame'] ELSE [] END) AS tag,
        unnest([{_SIDE(3)}, {_SIDE(7)}, NULL, {_SIDE(11)}, {_SIDE(13)}, NULL, {_SIDE(17)}] || CASE WHEN doc_id % 3 = 0 THEN [1.0::DOUBLE] ELSE [] END) AS w,
        unnest([{_SIDE(5)}, NULL, 2.5::DOUBLE, 10.0::DOUBLE, NULL, NULL, NULL] || CASE WHEN doc_id % 3 = 0 THEN [1.0::DOUBLE] ELSE [] END) AS h, unnest(range(7 + (doc_id % 3 = 0)::INT)) AS ord FROM documents)
    SELECT page_id, CAST(ord AS INT) AS ord, tag, w, h FROM listed"""

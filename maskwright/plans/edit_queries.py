"""Registered queries over reviewers' edits, and their SQL. Rectangles and strokes are made by rule, as no table holds any."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits
from ..sources import phrases
from ..sources.units import spread
from .oracle import TRIM


def _rects(spark, sf_dir):
    """Rectangles by rule, as no table holds any: 20 to a page, from the numbers of documents."""
    n = F.col("doc_id")
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.floor(n / 20).alias("page_id"), n.alias("mask_id"), (n * 37 % 400).cast("double").alias("x"), (n * 53 % 300).cast("double").alias("y"), (20 + n % 60).cast("double").alias("w"), F.lit(10.0).alias("h"), "text")


def bulk_unmask(spark, sf_dir):
    drags = _rects(spark, sf_dir).where("mask_id % 20 = 3").select("page_id", "x", "y", (F.col("w") * 2).alias("w"), (F.col("h") * 5).alias("h"))
    return edits.bulk_unmask(_rects(spark, sf_dir), drags).select("page_id", "mask_id")


def click_unmask(spark, sf_dir):
    clicks = _rects(spark, sf_dir).where("mask_id % 20 = 7").select("page_id", F.col("mask_id").alias("click_id"), (F.col("x") + 5).alias("x"), (F.col("y") + 5).alias("y"))
    return edits.click_unmask(_rects(spark, sf_dir), clicks).select("page_id", "mask_id")


def column_unmask(spark, sf_dir):
    masks = _rects(spark, sf_dir)
    gone = edits.column_members(masks, masks.where("mask_id % 20 = 5"))
    return masks.join(gone, ["page_id", "mask_id"], "left_anti").select("page_id", "mask_id")


def _strokes(spark, sf_dir):
    """Four strokes on each page of ``_rects``: a click, a wide drag, a click with alt, a drag with shift."""
    rects = _rects(spark, sf_dir).where("mask_id % 5 = 1")
    x, y = F.col("x") + 5, F.col("y") + 5
    kind = F.floor(F.col("mask_id") / 5) % 4
    reach = F.when(kind.isin(1, 3), 60.0).otherwise(1.0)
    return rects.select("page_id", F.col("mask_id").alias("seq"), x.alias("x0"), y.alias("y0"), (x + reach).alias("x1"), (y + reach).alias("y1"), (kind == 2).alias("alt"), (kind == 3).alias("shift"))


def edit_gestures(spark, sf_dir):
    return edits.gestures(_strokes(spark, sf_dir))


def edit_replay(spark, sf_dir):
    """Masks, revealed texts and the phrase that is offered after all strokes of each page, in order."""
    masks = _rects(spark, sf_dir).select("page_id", F.col("mask_id").alias("ord"), "x", "y", "w", "h", F.when(F.col("mask_id") % 7 == 0, "manual").otherwise("auto").alias("source"), F.lit("digit").alias("reason"), "text")
    return edits.replay(masks, edits.gestures(_strokes(spark, sf_dir)))


def phrase_register(spark, sf_dir):
    """Phrases that reviewers' clicks offered, behind a list of their own, with their reading as rules."""
    own = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("ord"), F.substring_index("text", " ", 1).alias("term"))
    return phrases.register_offered(own, edit_replay(spark, sf_dir))


QUERIES = {f.__name__: f for f in (bulk_unmask, click_unmask, column_unmask, edit_gestures, edit_replay, phrase_register)}

# -- SQL ------------------------------------------------------------------------------------------------------------
_RECTS = """WITH rects AS (SELECT doc_id // 20 AS page_id, doc_id AS mask_id, CAST(doc_id * 37 % 400 AS DOUBLE) AS x, CAST(doc_id * 53 % 300 AS DOUBLE) AS y,
    CAST(20 + doc_id % 60 AS DOUBLE) AS w, 10.0::DOUBLE AS h FROM documents)
"""
#: Edits of a page, one after another: the topmost mask at a point, its column, what goes, what is left and what is added.
STROKES = 4


def _replay(strokes: str, masks: str) -> str:
    steps = [f"ed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS k FROM ({strokes}))", f"p0 AS ({masks})", "o0 AS (SELECT * FROM p0 WHERE false)"]
    for k in range(1, STROKES + 1):
        steps.append(f"""
        t{k} AS (SELECT e.page_id, e.edit, max(m.ord) AS ord FROM ed e JOIN p{k - 1} m USING (page_id) WHERE e.k = {k} AND e.edit IN ('click', 'column')
            AND e.x BETWEEN m.x AND m.x + m.w AND e.y BETWEEN m.y AND m.y + m.h GROUP BY ALL),
        c{k} AS (SELECT page_id, ord FROM t{k} WHERE edit = 'column' UNION SELECT b.page_id, b.ord FROM c{k} c JOIN p{k - 1} a USING (page_id, ord)
            JOIN p{k - 1} b ON b.page_id = a.page_id AND least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) >= 0.5 * least(a.w, b.w)),
        g{k} AS (SELECT page_id, ord FROM t{k} WHERE edit = 'click' UNION SELECT page_id, ord FROM c{k} UNION SELECT m.page_id, m.ord FROM ed e JOIN p{k - 1} m USING (page_id)
            WHERE e.k = {k} AND e.edit = 'bulk' AND m.x < e.x + e.w AND e.x < m.x + m.w AND m.y < e.y + e.h AND e.y < m.y + m.h),
        s{k} AS (SELECT * FROM p{k - 1} SEMI JOIN g{k} USING (page_id, ord) WHERE source = 'auto' AND text <> ''),
        p{k} AS (SELECT * FROM p{k - 1} ANTI JOIN g{k} USING (page_id, ord) UNION ALL SELECT e.page_id, coalesce((SELECT max(ord) FROM p{k - 1} m WHERE m.page_id = e.page_id), -1) + 1, e.x, e.y, e.w, e.h, 'manual', 'manual', NULL
            FROM ed e WHERE e.k = {k} AND e.edit = 'add'),
        o{k} AS (SELECT * FROM o{k - 1} ANTI JOIN (SELECT page_id FROM g{k} JOIN ed USING (page_id) WHERE k = {k} AND (edit <> 'click' OR page_id IN (SELECT page_id FROM s{k}))) USING (page_id)
            UNION ALL SELECT s.* FROM s{k} s JOIN ed USING (page_id) WHERE ed.k = {k} AND ed.edit = 'click')""")
    shown = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, STROKES + 1))
    return f"""WITH RECURSIVE {", ".join(steps)}
        SELECT page_id, 'mask' AS state, * EXCLUDE (page_id) FROM p{STROKES} UNION ALL SELECT page_id, 'revealed', * EXCLUDE (page_id) FROM ({shown})
        UNION ALL SELECT page_id, 'offered', * EXCLUDE (page_id) FROM o{STROKES}"""


ORACLE_SQL = {
    "bulk_unmask": _RECTS + """SELECT page_id, mask_id FROM rects m WHERE NOT EXISTS (SELECT 1 FROM rects d WHERE d.mask_id % 20 = 3 AND d.page_id = m.page_id
        AND m.x < d.x + 2 * d.w AND d.x < m.x + m.w AND m.y < d.y + 5 * d.h AND d.y < m.y + m.h)""",
    "click_unmask": _RECTS + """, hit AS (SELECT c.mask_id AS click, max(m.mask_id) AS mask_id FROM rects c JOIN rects m ON m.page_id = c.page_id
        AND c.x + 5 BETWEEN m.x AND m.x + m.w AND c.y + 5 BETWEEN m.y AND m.y + m.h WHERE c.mask_id % 20 = 7 GROUP BY 1)
        SELECT page_id, mask_id FROM rects WHERE mask_id NOT IN (SELECT mask_id FROM hit)""",
    "column_unmask": "WITH RECURSIVE" + _RECTS[4:] + """, closure AS (SELECT page_id, mask_id FROM rects WHERE mask_id % 20 = 5 UNION SELECT b.page_id, b.mask_id FROM closure c
        JOIN rects a ON a.page_id = c.page_id AND a.mask_id = c.mask_id JOIN rects b ON b.page_id = a.page_id AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) >= 0.5 * least(a.w, b.w))
        SELECT page_id, mask_id FROM rects WHERE mask_id NOT IN (SELECT mask_id FROM closure)""",
    "edit_gestures": """WITH rects AS (SELECT doc_id // 20 AS page_id, doc_id AS seq, CAST(doc_id * 37 % 400 + 5 AS DOUBLE) AS x, CAST(doc_id * 53 % 300 + 5 AS DOUBLE) AS y, doc_id // 5 % 4 AS kind FROM documents WHERE doc_id % 5 = 1)
        SELECT page_id, seq, CASE kind WHEN 0 THEN 'click' WHEN 1 THEN 'add' WHEN 2 THEN 'column' ELSE 'bulk' END AS edit, CASE WHEN kind IN (0, 2) THEN x + 1 ELSE x END AS x, CASE WHEN kind IN (0, 2) THEN y + 1 ELSE y END AS y,
        CASE WHEN kind IN (0, 2) THEN 0.0 ELSE 60.0 END::DOUBLE AS w, CASE WHEN kind IN (0, 2) THEN 0.0 ELSE 60.0 END::DOUBLE AS h FROM rects""",
}
ORACLE_SQL["edit_replay"] = _replay(ORACLE_SQL["edit_gestures"], """SELECT doc_id // 20 AS page_id, doc_id AS ord, CAST(doc_id * 37 % 400 AS DOUBLE) AS x, CAST(doc_id * 53 % 300 AS DOUBLE) AS y,
    CAST(20 + doc_id % 60 AS DOUBLE) AS w, 10.0::DOUBLE AS h, CASE WHEN doc_id % 7 = 0 THEN 'manual' ELSE 'auto' END AS source, 'digit' AS reason, text FROM documents""")
ORACLE_SQL["phrase_register"] = f"""WITH listed AS (SELECT 0 AS list, item_id AS ord, {TRIM("string_split(text, ' ')[1]")} AS term FROM benchmark UNION ALL
        SELECT 1, page_id, {TRIM('text')} FROM ({ORACLE_SQL["edit_replay"]}) WHERE state = 'offered'),
    firsts AS (SELECT term, min((list, ord)) AS place FROM listed WHERE term <> '' GROUP BY term)
    SELECT CAST(row_number() OVER (ORDER BY place, term) - 1 AS INT) AS ord, term FROM firsts"""

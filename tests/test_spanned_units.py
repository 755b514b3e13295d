"""Flags of units that come row by row are those of units gathered to blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.functions.geometry import BOX, on_one_line
from maskwright.operators import spans
from maskwright.operators.spans import FLAGS, spanned_units, spread_units, with_spans
from maskwright.sources.units import blocks_of
from maskwright.vocab import Rules

TEXTS = ["ann@", "mail.example.org", "090-1234-", "5678", "99.95%", "+12", "件", "the", "and", "Save", "検索", "", None, "Σ", "x" * 40]
RULES = Rules(terms=("the and", "5678"))


@pytest.fixture()
def units(spark):
    """Blocks of 1 to 60 units, with null keys, null boxes and rows that do not come in order."""
    draw = np.random.default_rng(5)
    rows = []
    for k in range(40):
        for i in range(int(draw.integers(1, 60))):
            box = None if draw.random() < 0.1 else (0.0, float(draw.integers(3) * 10), 9.0, float(draw.integers(3) * 10 + 9))
            rows.append((None if k == 7 else k // 3, k % 3, i, TEXTS[draw.integers(len(TEXTS))], box))
    order = draw.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], f"a long, b int, unit_idx int, text string, bbox {BOX}")


@pytest.mark.parametrize("boxes", [True, False])
def test_as_gathered_blocks(spark, units, boxes, monkeypatch):
    monkeypatch.setattr(spans, "SLICE_BYTES", 300)
    units = units if boxes else units.select("a", "b", "unit_idx", "text", F.lit(1).alias("more"))
    gathered = spread_units(with_spans(blocks_of(units, ["a", "b"]), RULES)).select("a", "b", "unit_idx", "text", *FLAGS)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for rows in (1, 7, 5000):  # blocks that reach over many batches, and batches of many blocks
            spark.conf.set(name, str(rows))
            assert sorted(map(str, spanned_units(units, ["a", "b"], RULES).select(*gathered.columns).collect())) == sorted(map(str, gathered.collect()))
    finally:
        spark.conf.unset(name)


def test_rows_are_not_gathered(units):
    """No list of a block's rows goes to Python or is built before it."""
    plan = spanned_units(units, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan


def test_lines_of_boxes(spark):
    """The same lines as native columns tell, also with null, NaN and infinite sides."""
    sides = [None, float("nan"), float("inf"), float("-inf"), 0.0, 5.0]
    boxes = [None, *({"x0": 0.0, "y0": a, "x1": 1.0, "y1": b} for a in sides for b in sides)]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in boxes for b in boxes)]
    native = spark.createDataFrame(pairs, f"i int, a {BOX}, b {BOX}").select("i", on_one_line(F.col("a"), F.col("b")).alias("one")).orderBy("i").collect()
    kind = pa.struct([(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")])
    own = [bool(spans.on_one_line(pa.chunked_array([[a, b]], kind))[0]) for _, a, b in pairs]
    assert own == [r.one for r in native]


def test_whole_blocks():
    table = pa.table({"k": [1, 1, 2, 2, 2, 3]})
    got = [(t.column("k").to_pylist(), o.tolist()) for t, o in spans._whole_blocks(iter(table.to_batches(max_chunksize=2)), ["k"])]
    assert got == [([1, 1], [0, 2]), ([2, 2, 2], [0, 3]), ([3], [0, 1])]
    assert not list(spans._whole_blocks(iter([]), ["k"]))

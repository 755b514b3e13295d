"""The decision on each unit, masks and kept texts, and runs of masked units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..cluster import ship
from ..functions.geometry import BOX, around, on_one_line, to_rect
from ..functions.text import fold, masks, once, token_reason, trim, word_reason
from ..vocab import Rules
from .spans import same_block

DEFAULTS = {"line_reason": "string", "unit_metric": "boolean", "user_kept": "boolean", "label_kept": "boolean", "name_run": "string", "semantic": "string", "confidence": "double"}
#: What masks and kept texts carry along from their unit.
CARRIED = {"kind": "string", "table_id": "int", "col": "int"}


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with those of ``columns`` that it lacks, as nulls."""
    lacking = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns}
    return df.withColumns(lacking) if lacking else df


def decide(units: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``units`` (``text``, and any of ``DEFAULTS`` and ``token``) with ``mask`` and ``reason``.

    The user's terms win over every rule; then come measures, line patterns, the word's own verdict, and what its
    place on the page says. What is unknown is masked. Columns that are missing or null count as no evidence. The
    forms of a text, its own reason and the final one are each computed once, whatever is asked of the result.
    """
    names = [c for c in units.columns if c not in ("mask", "reason")]
    if "token" in units.columns:  # Spark's pruning below a generator loses columns where constants stand beside tokens
        units = with_missing(units, DEFAULTS)
    # what is missing is a constant, which rules over it drop out with
    there = set(units.columns)
    given = lambda c: F.col(c) if c in there else F.lit(None).cast(DEFAULTS[c])
    said = F.coalesce("text", F.lit(""))
    said = {"_raw": trim(said)} | ({"_surface": trim(F.coalesce(F.col("token")["surface_form"], said))} if "token" in units.columns else {})
    units = once(once(units, **said), _norm=fold(F.col(list(said)[-1])))
    own = word_reason(F.col("_norm"), F.col("_raw"), rules.labels)
    if "token" in units.columns:
        own = F.when(F.col("token").isNotNull(), token_reason(F.col("_norm"), F.col("token"), rules.labels)).otherwise(own)
    units = once(units, _own=F.coalesce(given("line_reason"), own))

    yes = lambda c: F.coalesce(given(c), F.lit(False))
    place = lambda p: F.coalesce(given("semantic") == p, F.lit(False))
    line, data, label = given("line_reason").isNotNull(), place("data"), place("label")
    masked = line | masks(F.col("_own"))
    faint = F.coalesce(given("confidence") < rules.noise, F.lit(False))
    data_like = F.col("_own").isin("digit", "at-mark") | line | data
    metric = yes("unit_metric") & ~data & ~F.coalesce(given("line_reason").startswith("email"), F.lit(False))
    reason = (
        F.when(yes("user_kept"), "user")
        .when(metric, "unit-metric")
        .when(~masked & data, "dom-data")
        .when(~masked & given("name_run").isNotNull() & ~label & ~yes("label_kept") & ~faint, given("name_run"))
        .when(~masked, F.col("_own"))
        .when(~data_like & label, "dom-label")
        .when(~data_like & yes("label_kept"), "label")
        .when(faint & ~data_like, F.concat(F.lit("noise("), F.floor(given("confidence") + 0.5).cast("string"), F.lit(")")))
        .otherwise(F.col("_own"))
    )
    decided = once(units, reason=reason)
    extra = [given(c).alias(c) for c in DEFAULTS if c not in names]
    return decided.select(*names, *extra, masks(F.col("reason")).alias("mask"), "reason")


def _islands(decided: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Masked units that merge, with the number of their ``island``: next to each other and of one reason."""
    merges = F.col("line_reason").isNotNull() | F.col("reason").isin("kanji-run", "kana-name")
    order = Window.partitionBy(*keys).orderBy(idx)
    rows = decided.where("mask").withColumn("merges", merges)
    follows = (F.lag(idx).over(order) == F.col(idx) - 1) & (F.lag("reason").over(order) == F.col("reason")) & F.lag("merges").over(order)
    rows = rows.withColumn("new", (~(F.col("merges") & F.coalesce(follows, F.lit(False)))).cast("int"))
    return rows.withColumn("island", F.sum("new").over(order)).drop("new")


def merge_runs(decided: DataFrame, keys: list[str], idx: str = "unit_idx") -> DataFrame:
    """Masked units next to each other for the same line-pattern or name reason as one: ``start, end, reason, text``.

    With ``bbox``, a unit that shares no height with the box of the run so far starts a run of its own, and the run
    has ``bbox`` and the ``kind, table_id, col`` of its first unit.
    """
    islands = _islands(decided, keys, idx)
    texts = lambda members: F.array_join(F.transform(members, lambda s: F.coalesce(s["text"], F.lit(""))), "")
    if "bbox" not in decided.columns:
        members = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), "text")))
        return islands.groupBy(*keys, "island").agg(F.min(idx).alias("start"), F.max(idx).alias("end"), F.first("reason").alias("reason"), texts(members).alias("text")).drop("island")
    islands = with_missing(islands, CARRIED).withColumn("bbox", F.col("bbox").cast(BOX))
    members = F.array_sort(F.collect_list(F.struct(F.col(idx).cast("int").alias("i"), "text", "bbox", "kind", "table_id", "col")))
    grouped = islands.groupBy(*keys, "island").agg(F.first("reason").alias("reason"), members.alias("members"))
    kind = f"array<struct<start: int, end: int, text: string, bbox: {BOX}, kind: string, table_id: int, col: int>>"

    def step(runs: Column, m: Column) -> Column:
        last = F.element_at(runs, -1)
        alone = F.struct(m["i"].alias("start"), m["i"].alias("end"), F.coalesce(m["text"], F.lit("")).alias("text"), m["bbox"].alias("bbox"), *(m[c].alias(c) for c in CARRIED))
        longer = F.struct(last["start"].alias("start"), m["i"].alias("end"), F.concat(last["text"], F.coalesce(m["text"], F.lit(""))).alias("text"), around(last["bbox"], m["bbox"]).alias("bbox"), *(last[c].alias(c) for c in CARRIED))
        joins = (F.size(runs) > 0) & on_one_line(F.try_element_at(runs, F.lit(-1))["bbox"], m["bbox"])
        return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(alone))).cast(kind)

    folded = F.aggregate("members", F.array().cast(kind), step)
    return grouped.select(*keys, "reason", F.explode(folded).alias("r")).select(*keys, "r.start", "r.end", "reason", "r.text", "r.bbox", "r.kind", "r.table_id", "r.col")


def merge_ordered_runs(decided: DataFrame, keys: list[str], idx: str = "unit_idx") -> DataFrame:
    """``merge_runs`` without boxes, for units that come as ``spread_units`` gives them: a block's rows one after another
    in order, in one partition. Nothing is shuffled or sorted; a block whose units are out of order is an error."""
    columns = [*keys, idx, "reason", "text", "merges"]
    merges = F.col("line_reason").isNotNull() | F.col("reason").isin("kanji-run", "kana-name")
    rows = decided.where("mask").withColumn("merges", merges).select(*columns)
    fields = {f.name: f for f in rows.schema.fields}
    ship(decided.sparkSession)
    schema = StructType([*(fields[k] for k in keys), StructField("start", fields[idx].dataType), StructField("end", fields[idx].dataType), fields["reason"], fields["text"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, open_ = to_arrow_schema(schema), None  # the last run of a batch may go on in the next
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if open_ is None else pa.concat_tables([open_, table])
            new = _run_starts(table, keys, idx)
            if not len(new):
                continue
            starts = np.flatnonzero(new)
            yield from _runs_between(table.slice(0, starts[-1]), starts[:-1], keys, idx, out)
            open_ = table.slice(starts[-1])
        if open_ is not None:
            yield from _runs_between(open_, np.zeros(1, np.int64), keys, idx, out)

    return rows.mapInArrow(run, schema)


def _run_starts(table: pa.Table, keys: list[str], idx: str) -> np.ndarray:
    """Rows that begin a run: those that do not follow the one before them in their block, for the same reason."""
    n = table.num_rows
    if n == 0:
        return np.zeros(0, bool)
    same = same_block(table, keys)
    at, merges = table.column(idx).to_numpy(), table.column("merges").to_numpy()
    if (same & (at[1:] <= at[:-1])).any():
        raise ValueError("units of a block must come in order")
    reason = table.column("reason").combine_chunks()
    alike = pc.equal(reason.slice(0, n - 1), reason.slice(1)).fill_null(False).to_numpy(zero_copy_only=False)
    return np.append(True, ~(same & (at[1:] == at[:-1] + 1) & alike & merges[1:].astype(bool) & merges[:-1].astype(bool)))


def _runs_between(table: pa.Table, starts: np.ndarray, keys: list[str], idx: str, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a table as runs that begin at ``starts``."""
    if not len(starts):
        return
    ends = np.append(starts[1:], table.num_rows)
    first, last = pa.array(starts), pa.array(ends - 1)
    text = table.column("text").combine_chunks().fill_null("")
    joined = text.take(first).to_pylist()
    for k in np.flatnonzero(ends - starts > 1).tolist():
        joined[k] = "".join(text.slice(starts[k], ends[k] - starts[k]).to_pylist())
    columns = [*(table.column(k).take(first) for k in keys), table.column(idx).take(first), table.column(idx).take(last), table.column("reason").take(first), pa.chunked_array([joined], pa.string())]
    yield from pa.table([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out).to_batches()


def masks_of(decided: DataFrame, keys: list[str], rules: Rules = Rules(), idx: str = "unit_idx") -> DataFrame:
    """Masks as rectangles: ``keys, ord, x, y, w, h, source, reason, text, kind, table_id, col``.

    Units masked on their own come in order, then the merged runs; ``ord`` counts within ``keys``.
    """
    merged = F.col("line_reason").isNotNull() | F.col("reason").isin("kanji-run", "kana-name")
    single = with_missing(decided.where(F.col("mask") & ~merged), CARRIED)
    both = single.select(*keys, F.lit(0).alias("part"), F.col(idx).alias("start"), "bbox", "reason", "text", *CARRIED)
    runs = merge_runs(decided.where(merged), keys, idx)
    both = both.unionByName(runs.select(*keys, F.lit(1).alias("part"), "start", "bbox", "reason", "text", *CARRIED))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("part", "start")) - 1
    rect = [c.alias(n) for n, c in to_rect(F.col("bbox"), rules.padding, rules.scale).items()]
    return both.select(*keys, order.alias("ord"), *rect, F.lit("auto").alias("source"), "reason", "text", *CARRIED)


def kept_of(decided: DataFrame, keys: list[str], rules: Rules = Rules(), idx: str = "unit_idx") -> DataFrame:
    """Texts that stay as rectangles without padding: ``keys, unit_idx, x, y, w, h, reason, text, kind, table_id, col``."""
    rect = [c.alias(n) for n, c in to_rect(F.col("bbox"), 0.0, rules.scale).items()]
    return with_missing(decided.where("NOT mask"), CARRIED).select(*keys, idx, *rect, "reason", "text", *CARRIED)


def mask_text(text: Column, pattern: str, mark: str) -> Column:
    """``text`` with all that ``pattern`` matches replaced."""
    return F.regexp_replace(text, pattern, mark)

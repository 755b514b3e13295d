"""Reviewers' edits against plain Python: joins by tiles, columns, replay of logs, streams."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from maskwright.operators import edits
from maskwright.operators.edits import PageEdits, bulk_unmask, click_unmask, column_components, column_members

RECT = "page_id long, mask_id long, x double, y double, w double, h double"


def _rects(rng, n, pages=3):
    """Rectangles of sizes from nothing to a whole screen, some at whole places, so that sides touch."""
    side = lambda: rng.choice([0.0, 1.0, 5.0, 7.5, 60.0, 900.0]) * rng.choice([1, 1, rng.random()])
    place = lambda: rng.choice([float(rng.randrange(-40, 300)), rng.random() * 300])
    return [(rng.randrange(pages), i, place(), place(), side(), side()) for i in range(n)]


def test_joins_by_tile(spark):
    rng = random.Random(1)
    masks, drags = _rects(rng, 400), _rects(rng, 25)
    clicks = [(p, i, x, y) for p, i, x, y, _, _ in _rects(rng, 60)]
    df = spark.createDataFrame([*masks, (0, 1000, None, 0.0, 1.0, 1.0), (0, 1001, 0.0, 0.0, -1.0, 1.0)], RECT).withColumns({c: F.lit("clash") for c in ("level", "tile_x", "tile_y")})
    over = lambda a, b: a[0] == b[0] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]
    want = {m[1] for m in masks if not any(over(m, d) for d in drags)} | {1000, 1001}
    left = bulk_unmask(df, spark.createDataFrame(drags, RECT))
    assert {r.mask_id for r in left.collect()} == want and left.columns == df.columns and 20 < len(want) < 390
    hit = set()
    for p, _, x, y in clicks:
        holds = [m[1] for m in masks if m[0] == p and m[2] <= x <= m[2] + m[4] and m[3] <= y <= m[3] + m[5]]
        hit |= {max(holds)} if holds else set()
    kept = click_unmask(df, spark.createDataFrame(clicks, "page_id long, click_id long, x double, y double"))
    assert {r.mask_id for r in kept.collect()} == {m[1] for m in masks} - hit | {1000, 1001} and len(hit) > 10
    for plan in (left, kept):
        assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    assert bulk_unmask(df, spark.createDataFrame([], RECT)).count() == 402 and bulk_unmask(df.where("false"), spark.createDataFrame(drags, RECT)).count() == 0


def test_one_large_page(spark):
    """A page of 100,000 masks: each drag finds those in its reach alone."""
    n = 100_000
    masks = spark.range(n).select(F.lit(1).cast("long").alias("page_id"), F.col("id").alias("mask_id"), (F.col("id") % 400 * 10.0).cast("double").alias("x"), F.floor(F.col("id") / 400).cast("double").alias("y"), F.lit(8.0).alias("w"), F.lit(0.5).alias("h"))
    drags = spark.createDataFrame([(1, 0.0, 0.0, 35.0, 2.0), (1, 3000.0, 100.0, 1.0, 1.0)], "page_id long, x double, y double, w double, h double")
    assert bulk_unmask(masks, drags).count() == n - 4 * 2 - 1
    assert column_members(masks, masks.where("mask_id = 7")).count() == n // 400


def _plain_components(x, w):
    n = len(x)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                shared = min(x[i] + w[i], x[j] + w[j]) - max(x[i], x[j])
                if shared > 0 and shared >= 0.5 * min(w[i], w[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_columns_by_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 25)
        x, w = np.array([float(rng.randrange(40)) for _ in range(n)]), np.array([float(rng.choice([0, 1, 2, 4, 4, 10, 30])) for _ in range(n)])
        assert column_components(x, w).tolist() == _plain_components(x.tolist(), w.tolist())
    assert column_components(np.zeros(0), np.zeros(0)).tolist() == []
    # a long chain of halves is one column
    chain = np.arange(20_000) * 5.0
    assert set(column_components(chain, np.full(20_000, 10.0)).tolist()) == {0}


def test_column_members(spark):
    masks = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 4.0, 10.0), (1, 3, 9.0, 10.0), (1, 4, 100.0, 10.0), (1, 5, None, 10.0), (2, 1, 0.0, 10.0), (None, 1, 0.0, 10.0)], "page_id long, mask_id long, x double, w double")
    seeds = spark.createDataFrame([(1, 1), (1, 1), (2, 9), (1, 5), (None, 1)], "page_id long, mask_id long")
    got = sorted(tuple(r) for r in column_members(masks, seeds).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 5), (2, 9)] and column_members(masks, seeds.where("false")).count() == 0


def _plain_replay(masks, log):
    """One edit after another over a list of dictionaries."""
    now, revealed, offered = sorted(masks, key=lambda m: m["ord"]), [], None
    for e in sorted(log, key=lambda e: e["seq"]):
        x, y, w, h = (e[c] for c in "xywh")
        if e["edit"] == "add":
            now.append({"ord": max((m["ord"] for m in now), default=-1) + 1, "x": x, "y": y, "w": w, "h": h, "source": "manual", "reason": "manual", "text": None})
            continue
        if e["edit"] == "bulk":
            gone = [m for m in now if m["x"] < x + w and x < m["x"] + m["w"] and m["y"] < y + h and y < m["y"] + m["h"]]
        else:
            holds = [i for i, m in enumerate(now) if m["x"] <= x <= m["x"] + m["w"] and m["y"] <= y <= m["y"] + m["h"]]
            if not holds:
                continue
            labels = _plain_components([m["x"] for m in now], [m["w"] for m in now])
            gone = [m for m, label in zip(now, labels, strict=True) if label == labels[holds[-1]]] if e["edit"] == "column" else [now[holds[-1]]]
        if not gone:
            continue
        now = [m for m in now if m not in gone]
        shown = [m for m in gone if m["source"] == "auto" and m["text"]]
        revealed += shown
        offered = shown[0] if e["edit"] == "click" and shown else offered if e["edit"] == "click" else None
    parts = [("mask", m) for m in now] + [("revealed", m) for m in revealed] + ([("offered", offered)] if offered else [])
    return sorted(json.dumps([state, *m.values()]) for state, m in parts)


def _page(rng):
    masks = [{"ord": i, "x": float(rng.randrange(60)), "y": float(rng.randrange(60)), "w": float(rng.randrange(1, 25)), "h": float(rng.randrange(1, 25)), "source": rng.choice(["auto", "auto", "manual"]), "reason": "digit", "text": rng.choice([f"t{i}", "", None])} for i in range(rng.randrange(14))]
    log = [{"seq": i * 3, "edit": rng.choice(["click", "click", "column", "bulk", "add"]), "x": float(rng.randrange(70)), "y": float(rng.randrange(70)), "w": float(rng.randrange(1, 20)), "h": float(rng.randrange(1, 20))} for i in range(rng.randrange(12))]
    return masks, log


def _result(page):
    return sorted(json.dumps(list(r)) for r in page.result())


def test_any_split_of_a_log():
    """However masks and edits come, in parts and out of order, through packed states: as all at once, and as plainly."""
    rng = random.Random(3)
    for _ in range(200):
        masks, log = _page(rng)
        rows = [("mask", tuple(m.values())) for m in masks] + [("edit", tuple(e.values())) for e in log]
        if rng.random() < 0.7:
            rng.shuffle(rows)
        page = PageEdits()
        while rows:
            n = rng.randrange(1, 6)
            page.take([r for k, r in rows[:n] if k == "mask"], [r for k, r in rows[:n] if k == "edit"])
            page, rows = PageEdits.unpacked(page.packed()), rows[n:]
        assert _result(page) == _plain_replay(masks, log)


def test_replay_of_tables_and_streams(spark, tmp_path):
    rng = random.Random(4)
    pages = {p: _page(rng) for p in range(12)}
    masks = spark.createDataFrame([(p, *m.values()) for p, (own, _) in pages.items() for m in own], "page_id long, ord long, x double, y double, w double, h double, source string, reason string, text string")
    log = spark.createDataFrame([(p, *e.values()) for p, (_, own) in pages.items() for e in own], "page_id long, seq long, edit string, x double, y double, w double, h double")
    want = {p: _plain_replay(own, own_log) for p, (own, own_log) in pages.items()}

    def by_page(df):
        out = {p: [] for p in pages}
        for r in df.collect():
            out[r.page_id].append(json.dumps([r.state, r.ord, r.x, r.y, r.w, r.h, r.source, r.reason, r.text]))
        return {p: sorted(rows) for p, rows in out.items()}

    assert by_page(edits.replay(masks, log)) == want
    events = edits.edit_events(masks, log)
    rows = events.collect()
    rng.shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i::4], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = edits.replay_stream(stream).writeStream.outputMode("update").format("memory").queryName("edits").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    versions = spark.table("edits")
    assert versions.agg(F.max("version")).first()[0] > 1
    assert by_page(edits.latest(versions)) == want


def test_phrases_numbered_over_ranges(spark):
    from maskwright.sources.phrases import merge_phrases

    rows = spark.range(5000).select((F.col("id") * 7 % 5000).alias("ord"), F.concat(F.lit(" t"), (F.col("id") * 7 % 5000 % 1500).cast("string")).alias("term"))
    got = merge_phrases(rows.repartition(8), spark.createDataFrame([(0, "last"), (1, "t3")], "ord long, term string")).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(1501)) and [r.term for r in got] == [*(f"t{i}" for i in range(1500)), "last"]

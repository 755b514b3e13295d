import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import queries as Q
from maskwright.llm.ann import nearest_neighbours
from maskwright.llm.licenses import scan_licenses
from maskwright.llm.mixing import mix_sources, repeated
from maskwright.llm.quotes import link_quotes, parse_levels
from maskwright.llm.toxicity import Grams, score_toxicity, train_toxicity

from .conftest import SF


def _nearest(rows, queries, k):
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in sound:
        if q in queries:
            best = sorted((-float(v @ w), i) for i, w in sound if i != q)[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def test_op2_recall(spark):
    import duckdb

    got = Q.op2_nearest_neighbours(spark, "/root/testdata/sf0.01").toPandas()
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hits = asked = 0
    for q, own in got.groupby("query_id"):
        scores = v @ v[ids == q][0]
        scores[ids == q] = -9
        want = ids[np.lexsort((ids, -scores))[:20]]
        assert own.sort_values("rank")["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, [v[ids == i][0] @ v[ids == q][0] for i in own.vec_id], atol=1e-12)
        hits += len(set(want) & set(own.vec_id))
        asked += 20
    assert asked == 20 * (ids % 20 == 0).sum() and hits >= 0.9 * asked


def test_nearest_over_shards_lengths_and_repeated_ids(spark):
    """Several shards against brute force; a query's own id repeated more often than there are neighbours; two lengths."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 64))
    rows = [(i, (centres[i % 30] + 0.5 * rng.standard_normal(64)).tolist()) for i in range(1500)]
    rows += [(0, rows[0][1])] * 40 + [(2000 + i, rng.standard_normal(8).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in nearest_neighbours(df, df.where("vec_id % 20 = 0 AND vec_id > 0 OR vec_id = 0").dropDuplicates(["vec_id"]), shard=200).collect():
        got[x.query_id].append((x.rank, x.vec_id))
    hits = asked = 0
    for dims in (64, 8):
        own = [(i, np.array(v)) for i, v in rows if len(v) == dims]
        ids, v = np.array([i for i, _ in own]), np.array([x for _, x in own])
        for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
            scores = v @ v[ids == q][0]
            others = np.flatnonzero(ids != q)
            best = others[np.lexsort((ids[others], -scores[others]))][:20]
            found = [i for _, i in sorted(got[q])]
            assert len(found) == 20 and q not in found
            hits, asked = hits + sum((Counter(found) & Counter(ids[best].tolist())).values()), asked + 20  # each row counts
    assert len(got) == asked // 20 and hits >= 0.9 * asked


def test_nearest_odd_vectors(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    rows += [(40, None), (41, []), (42, [0.0, 0.0, 0.0]), (43, [1.0, None, 2.0]), (44, [float("nan"), 1.0, 1.0]), (45, [float("inf"), 1.0, 1.0]), (46, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(50 + i, [5.0, 5.0, 5.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cell", F.lit("x"))
    got = defaultdict(list)
    for x in nearest_neighbours(df, df.where("vec_id % 20 = 0 OR vec_id = 50"), k=100).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, pytest.approx(x.score, abs=1e-12)))
    assert dict(got) == _nearest(rows, {0, 20, 40, 50}, 100)
    assert nearest_neighbours(df.where("false"), df).count() == 0
    assert nearest_neighbours(df, df.where("false")).count() == 0


def test_distinct_grams():
    grams = Grams(sizes=(2, 3), bits=24)
    text = "Abab ab"
    padded = f" {text.lower()} "
    assert len(grams.distinct(text)) == len({padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)})
    assert len(grams.distinct("")) == 1


def test_op3_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    own = got[got.held_out]
    rank = own.score.rank().to_numpy()
    p = int(own.toxic.sum())
    auc = (rank[own.toxic == 1].sum() - p * (p + 1) / 2) / (p * (len(own) - p))
    assert auc > 0.95
    assert (own[own.predicted == 1].toxic == 1).mean() > 0.9
    assert ((got.score >= 0.7).astype(int) == got.predicted).all() and got.score.between(0, 1).all()


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (5, 0), (6, 1), (6, 0), (7, None), (None, 1), (9, 7)], "doc_id long, toxic int")
    model = train_toxicity(odd, labels)
    scored = score_toxicity(odd, model).collect()
    assert len(scored) == 12 and all(0 <= r.score <= 1 for r in scored)
    nothing = train_toxicity(odd, labels.where("false"))
    assert {r.score for r in score_toxicity(odd, nothing).collect()} == {0.5}
    assert score_toxicity(empty, model).count() == 0
    assert train_toxicity(empty, labels).bias == 0


def _mix(rows, share, weights, epochs, seed):
    """rows: (path, id, text, tokens). Water-filling and prefixes, one by one."""
    tokens = Counter()
    for path, _, _, t in rows:
        tokens[path] += t
    budget = {(): min(share * sum(tokens.values()), epochs * sum(tokens.values()))}
    for depth in range(3):
        for parent in {p[:depth] for p in tokens}:
            cap = Counter()
            for p, t in tokens.items():
                if p[:depth] == parent:
                    cap[p[: depth + 1]] += t * epochs
            weight = {c: weights.get((depth, c[-1]), 1.0) for c in cap}
            left, open_ = budget.get(parent, 0.0), {c for c in cap if weight[c] > 0 and cap[c] > 0}
            for c in cap:
                budget[c] = 0.0
            while open_:
                unit = left / sum(weight[c] for c in open_)
                full = {c for c in open_ if cap[c] <= unit * weight[c] + 1e-9}
                if not full:
                    for c in open_:
                        budget[c] = unit * weight[c]
                    break
                for c in full:
                    budget[c] = float(cap[c])
                    left -= cap[c]
                open_ -= full
    out = Counter()
    for leaf, total in tokens.items():
        b = math.floor(budget[leaf] + 1e-6)
        whole = b // total if total else 0
        rest, own = b - whole * total, [r for r in rows if r[0] == leaf]
        key = lambda r: int(hashlib.md5(f"{seed}|{whole}|{'' if r[1] is None else r[1]}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        peers = defaultdict(list)
        for r in own:
            peers[(key(r), r[2] or "")].append(r)
        used, going = 0, rest > 0
        for k in sorted(peers):
            used += sum(r[3] for r in peers[k])
            going = going and used <= rest
            for r in peers[k]:
                out[(r[1], whole + going)] += 1
    return out


@pytest.mark.parametrize("share,last", [(1.0, 256), (0.4, 4), (9.0, 4)])
def test_op4_brute_force(spark, monkeypatch, share, last):
    from maskwright.llm import mixing as module

    monkeypatch.setattr(module, "LAST_ROWS", last)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("domain", Q.domain("source")).withColumn("lang", F.when(F.col("doc_id") % 17 > 0, F.col("lang")))
    rows = [((r.domain, r.lang or "", r.source), r.doc_id, r.text, r.t) for r in docs.withColumn("t", module.word_count(F.col("text"))).collect()]
    got = mix_sources(docs, share=share, weights=Q.mixing_weights(spark), seed=3).collect()
    want = _mix(rows, share, {(a, b): c for a, b, c in Q.WEIGHTS}, 4, 3)
    assert Counter((r.doc_id, r.copies) for r in got) == want
    assert sum(c for c in want.values()) == docs.count()


def test_mixing_odd_rows(odd, empty):
    docs = odd.withColumn("domain", F.lit(None).cast("string"))
    mixed = mix_sources(docs)
    assert mixed.count() == 12 and set(docs.columns) == set(mixed.columns)
    assert {r.copies >= 0 for r in mixed.collect()} == {True}
    assert repeated(mix_sources(docs, share=9.0)).count() == 4 * (12 - 2)  # two leaves hold no tokens
    assert mix_sources(empty.withColumn("domain", F.lit("x"))).count() == 0


MAIL = [
    (1, 0, "user", "Shall we meet on Monday morning?\nThe room is free then."),
    (1, 1, "bot", "On Friday, A wrote:\n> Shall we meet on Monday morning?\n> The room is free then.\nYes, Monday suits me very well."),
    (1, 2, "user", "> > Shall we meet on Monday morning?\n> Yes, Monday suits me very well.\nThen it is settled."),
    (1, 3, "bot", "> the ROOM  is free then.\nI have booked the room."),
    (1, 4, "user", "> never said by anyone here\nWhat is this?"),
    (2, 0, "user", None),
    (2, 0, "user", ""),
    (2, 5, "bot", "> Shall we meet on Monday morning?\nAnother conversation."),
    (None, 0, "user", "no conversation"),
    (None, None, None, "no turn"),
]


def test_quotation_linking(spark):
    df = spark.createDataFrame(MAIL, "conv_id long, turn long, role string, text string").withColumns({"hash": F.lit(1), "rid": F.lit("x")})
    got = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    one = [got[(1, t)] for t in range(5)]
    assert [r.reply_to for r in one] == [None, 0, 1, 0, 3]
    assert [r.depth for r in one] == [0, 1, 2, 1, 2]
    assert [r.thread for r in one] == [0] * 5
    assert [r.text for r in one] == ["Shall we meet on Monday morning?\nThe room is free then.", "Yes, Monday suits me very well.", "Then it is settled.", "I have booked the room.", "> never said by anyone here\nWhat is this?"]
    assert [r.n_quotes for r in one] == [0, 1, 2, 1, 1] and one[4].linked_quotes == 0
    assert [r.position for r in one] == [0, 1, 2, 3, 4]
    assert got[(2, 5)].text == "> Shall we meet on Monday morning?\nAnother conversation."
    assert got[(2, 5)].reply_to == 0 and got[(2, 5)].linked_quotes == 0
    assert got[(None, 0)].reply_to is None and got[(None, 0)].depth == 1 and got[(None, None)].depth == 0
    assert link_quotes(df).count() == 10 and link_quotes(df.where("false")).count() == 0
    assert [a for a, _ in parse_levels("a\n>> b\n> c\n> > d\ne")] == [0, 2, 1, 2, 0]


def test_op7_chains(spark):
    """Without quotes each message answers the one before; long conversations count on."""
    got = Q.op7_quotation_linking(spark, SF).toPandas().sort_values(["conv_id", "turn"])
    assert (got.depth == got.groupby("conv_id").cumcount()).all()
    long = spark.range(500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.when(F.col("id") % 100 == 99, F.concat(F.lit("> message number "), F.col("id") - 50)).otherwise(F.concat(F.lit("message number "), F.col("id"))).alias("text"))
    depth = {}
    for r in sorted(link_quotes(long).collect(), key=lambda r: r.turn):
        want = r.turn - 50 if r.turn % 100 == 99 else r.turn - 1 if r.turn else None
        assert r.reply_to == want
        depth[r.turn] = depth[want] + 1 if r.turn else 0
        assert r.depth == depth[r.turn] and r.thread == 0


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
        (2, "a/src/x.py", "code here"),
        (3, "a/src/deep/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "b/z.py", "nothing"),
        (5, "ab/z.py", "nothing"),
        (6, "a/src/deep/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (7, "a/src/deep/er/w.py", None),
        (8, None, "Nothing is released\n\nby anybody in particular, as all the rest of this text says."),
        (9, "top.py", ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string").withColumns({"dir": F.lit(1), "header": F.lit(2)})
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in scan_licenses(df, F.col("p")).collect()}
    assert got == {
        1: ("MIT", "header", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "header", None), 4: (None, "none", None), 5: (None, "none", None),
        6: ("GPL-3.0", "header", None), 7: ("GPL-3.0", "inherited", "a/src/deep"), 8: (None, "none", None), 9: (None, "none", None),
    }
    assert scan_licenses(df.where("false"), F.col("p")).count() == 0


def test_op10_finds_all_notices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id").text
    got = Q.op10_license_scan(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id").header_license
    notices = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    want = {i: next((v for k, v in notices.items() if k in t.split("\n")), None) for i, t in docs.items()}
    assert {i: got[i] for i in want} == want

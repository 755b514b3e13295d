"""Product codes against plain Lloyd rounds in whole integers."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from maskwright.llm import queries as Q
from maskwright.llm.vector_codes import label_errors, vector_codes

from .conftest import SF


def _plain(rows, parts=4, entries=256, rounds=4):
    """Every part against every entry in every round. Rows are (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, [math.floor(1024 * x) for x in v] + [0] * (width - len(v)), label) for i, v, label in kept]
    first = kept[:entries]
    step = width // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[nearest(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[nearest(v, p) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, [k for _, k in f], e, by_label[label]) for (i, _, label), f, e in zip(kept, found, errors, strict=True)), key=repr), sha


def _found(df, **more):
    coded, books = vector_codes(df, **more)
    rows = label_errors(coded).select("vec_id", "codes", "error", "label_error").collect()
    return sorted(((r.vec_id, list(r.codes), r.error, r.label_error) for r in rows), key=repr), books.digest()


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("codes", "error", "label_error", "cells", "v", "times")})


def test_given_vectors(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, sha = _plain(rows)
    got = {r.vec_id: r for r in Q.op12_vector_codes(spark, SF).collect()}
    assert len(got) == len(want) == len(rows)
    for i, codes, error, label_error in want:
        r = got[i]
        assert (r.code, r.error, r.label_error, r.codebooks_sha256) == ("".join(f"{k:02x}" for k in codes), error, label_error, sha)


def test_ties_nulls_and_odd_vectors(spark):
    """Few values, so that many distances tie; nulls, repeated rows and ids, lengths of all kinds."""
    rng = random.Random(3)
    rows = [(rng.choice([i, i, 7]), [rng.choice([-1.5, 0.0, 0.001, 1.5]) for _ in range(rng.choice([8, 8, 6, 0]))], rng.choice([0, 0, 1, None])) for i in range(300)]
    rows += [(1000, None, 0), (1001, [None, 1.0], 0), (1002, [float("nan")], 1), (1003, [float("inf"), 1.0], 1), (None, [0.5] * 8, None)] + rows[:20]
    for entries, rounds in ((16, 4), (1, 2), (400, 3)):
        assert _found(_frame(spark, rows), entries=entries, rounds=rounds) == _plain(rows, entries=entries, rounds=rounds)


def test_huge_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 6]) for _ in range(8)], i % 3) for i in range(120)]
    assert _found(_frame(spark, rows), entries=12) == _plain(rows, entries=12)


def test_no_vectors(spark):
    assert _found(_frame(spark, []))[0] == [] and _found(_frame(spark, [(1, None, 1)]))[0] == []
    assert _found(_frame(spark, [(1, [], None)])) == ([(1, [0, 0, 0, 0], 0, 0)], hashlib.sha256(b"").hexdigest())

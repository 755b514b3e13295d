"""Quality scores: statistics against plain Python, the discriminant against its formula, held-out accuracy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import queries as Q
from maskwright.llm.quality import FIELDS, REACH, SPAN, STOPS, measure, score_quality, statistics, train_quality, transformed

from .conftest import ROWS

TEXTS = [t or "" for _, t, _, _ in ROWS] + ["Ab c c ÉA !! 12\nx", "a b " * 200, "日本 a a a 😀 Ǆ", " \n", "z" * 300_000 + " Q q q"]


def _counted(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    sizes = [len(w.encode()) for w in words]
    letters = [c for c in text if c.isalpha() and ord(c) < 1 << 16]
    return {
        "chars": len(text), "words": len(words), "letters": len(letters), "capitals": sum(c.isupper() or c.istitle() for c in letters), "digits": sum(c.isdigit() for c in text), "stops": sum(c in STOPS for c in text),
        "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)), "distinct": sum(len(set(words[i : i + SPAN])) for i in range(0, len(words), SPAN)), "length": sum(sizes),
        "square": sum(s * s for s in sizes), "short": sum(s <= 3 for s in sizes), "titles": sum(w[0].isupper() or w[0].istitle() for w in words), "lines": text.count("\n"),
    }


def test_statistics():
    for text, row in zip(TEXTS, statistics(TEXTS), strict=True):
        got = dict(zip(FIELDS, row, strict=True))
        for name, want in _counted(text).items():
            assert got[name] == want, (text[:40], name)


def test_scores_by_formula(spark):
    """Means, covariances and densities written out once more, over all labelled texts."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = train_quality(measure(docs), labels)
    rows = docs.join(labels, "doc_id").select("text", "quality").collect()
    y = np.array([r.quality for r in rows])
    x = transformed(statistics([r.text or "" for r in rows]), model.typical)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), -REACH, REACH)
    logs = []
    for label in (0, 1):
        own = z[y == label]
        s = np.cov(own.T, bias=True)
        s = 0.95 * s + (0.05 * np.trace(s) / len(s) + 1e-6) * np.eye(len(s))
        d = z - own.mean(axis=0)
        logs.append(math.log(len(own) / len(z)) - np.linalg.slogdet(s)[1] / 2 - np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) / 2)
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert model.scores(statistics([r.text or "" for r in rows])) == pytest.approx(want, abs=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op13_quality(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    low, high = ([r.score for r in rows if r.quality == k] for k in (0, 1))
    assert np.mean([np.mean(np.array(low) < s) for s in high]) > 0.99
    assert sum(r.predicted == 0 for r in rows if r.quality == 0) >= 0.95 * len(low)
    assert sum(r.predicted == 0 for r in rows if r.quality == 1) <= 0.01 * len(high)


def test_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 0), (6, 2), (6, None), (None, 1), (3, 0), (3, 1), (99, 1)], "doc_id long, quality int")
    odd, empty = measure(odd.withColumn("statistics", F.lit("clash"))), measure(empty)
    model = train_quality(odd, labels)
    scored = score_quality(odd.drop("score"), model)
    assert scored.columns == [*odd.drop("score", "statistics").columns, "score"] and scored.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert score_quality(odd, model).count() == odd.count() and score_quality(empty, model).count() == 0
    # labels of one kind, or none, give their share
    for marks, share in ((labels.where("quality = 1"), 1.0), (labels.where("false"), 0.5)):
        assert {r.score for r in score_quality(odd, train_quality(odd, marks)).collect()} == {share}
    assert {r.score for r in score_quality(odd, train_quality(empty, labels)).collect()} == {0.5}
    # equal texts everywhere: no statistic varies
    same = measure(odd.withColumn("text", F.lit("all alike")))
    assert len({round(r.score, 9) for r in score_quality(same, train_quality(same, labels)).collect()}) == 1

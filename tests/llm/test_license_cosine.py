"""The measure of headers against plain Python over whole documents."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskwright.llm import queries as Q
from maskwright.llm.licenses import LEAST, TEMPLATES, scan_licenses

from .conftest import SF


def _line_words(text):
    """Words of each line: letters and digits of any script, ``-`` too; a lone ``-`` is a word."""
    return [re.findall(rb"[0-9a-z\x80-\xff-]+", line.lower()) for line in text.encode().split(b"\n")]


def _spans(text):
    lines = _line_words(text)
    paragraphs, open_ = [], []
    for words in [*lines, []]:
        if words:
            open_ += words
        elif open_:
            paragraphs.append(open_)
            open_ = []
    return [w for w in lines if w], paragraphs


def _flat(text):
    return [w for line in _line_words(text) for w in line]


def test_cosine_by_brute_force(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    models = [(name, Counter(_flat(t))) for name, texts in TEMPLATES.items() for t in texts]
    vocabulary = {w for _, m in models for w in m}
    held, n = Counter(), len(docs)
    for _, text in docs:
        held.update(set(_flat(text)) & vocabulary)
    idf = {w: math.log((n + 1) / (held[w] + 1)) + 1 for w in vocabulary}
    rarest = math.log(n + 1) + 1
    norms = [math.sqrt(sum((k * idf[w]) ** 2 for w, k in m.items())) for _, m in models]

    def cosine(words):
        counts = Counter(words)
        square = sum((k * idf[w]) ** 2 if w in vocabulary else k * rarest**2 for w, k in counts.items())
        return max(sum(k * idf[w] ** 2 * counts[w] for w, k in m.items()) / norm / math.sqrt(square) for (_, m), norm in zip(models, norms, strict=True))

    want = {i: max([cosine(w) for kind in _spans(text) for w in kind if vocabulary & set(w)], default=0.0) for i, text in docs}
    got = {r.doc_id: r for r in Q.op10_license_scan(spark, SF).collect()}
    assert len(got) == n and {i: r.cosine for i, r in got.items()} == pytest.approx(want, abs=1e-8)
    assert all((r.header_license is not None) == (want[i] >= LEAST) for i, r in got.items())
    assert any(r.header_license for r in got.values())


def test_odd_texts_and_ties(spark):
    """Very long texts, repeated rows, ties of two files in one directory: each has its defined result."""
    mit = "Released under the MIT License."
    long = "plain words " * 150_000
    rows = [(1, "d/LICENSE", mit), (1, "d/LICENSE", mit), (2, "d/COPYING", "Licensed under CC BY 4.0."), (3, "d/a.txt", long), (4, "e/a.txt", long + "\n\n" + mit), (5, "e/b.txt", None), (None, None, mit)]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string").withColumn("license", F.lit("clash"))
    got = sorted(((r.doc_id or 0, r.license, r.origin) for r in scan_licenses(df, F.col("p")).collect()))
    assert len(got) == 7 and got.count((1, "MIT", "header")) == 2 and (4, "MIT", "header") in got and (0, "MIT", "header") in got
    # of two files of one directory the nearer counts, of equals the first by name; nothing is inherited sideways
    inherited = {license for i, license, origin in got if origin == "inherited"}
    assert (5, None, "none") in got and inherited == {x[1] for x in got if x[0] == 3}
    assert [x for x in got if x[0] == 3][0][1] in ("MIT", "CC-BY-4.0")


def _plain_inheritance(rows, own):
    """(id, path) -> licence and origin: ``own`` says what each row has itself (licence, origin), or is a directory's."""
    given = {}
    for i, path in rows:
        license, _, is_file = own[i]
        if is_file and path is not None:
            directory, _, name = path.rpartition("/")
            given.setdefault(directory, []).append((name, license))
    out = {}
    for i, path in rows:
        license, origin, _ = own[i]
        at = None
        if license is None and path is not None:
            parts = path.split("/")[:-1]
            for k in range(len(parts), -1, -1):
                if "/".join(parts[:k]) in given:
                    at = "/".join(parts[:k])
                    license, origin = min(given[at])[1], "inherited"
                    break
        out[i] = license, origin, at
    return out


def test_inheritance_by_brute_force(spark):
    """Thousands of paths: nested directories, several files in one, ordinary texts that hold a notice, rows without paths."""
    import random

    rng = random.Random(11)
    # one notice each, so that all licence files are equally near and the first by name counts
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-4.0": "Licensed under CC BY 4.0."}
    rows, own = [], {}
    for i in range(4000):
        parts = [rng.choice("abcd") for _ in range(rng.randrange(6))]
        draw = rng.random()
        license = rng.choice(list(notices))
        if draw < 0.02:
            name, text, own[i] = rng.choice(["LICENSE", "COPYING.txt", "notice.md", "Unlicense"]), notices[license], (license, "header", True)
        elif draw < 0.1:
            name, text, own[i] = f"f{i}.txt", f"words of no licence at all\n{notices[license]}", (license, "header", False)
        elif draw < 0.12:
            name, text, own[i] = "LICENSE", "nothing known", (None, "none", False)
        else:
            name, text, own[i] = f"f{i}.txt", rng.choice([None, "", "plain words"]), (None, "none", False)
        path = None if rng.random() < 0.03 else "/".join([*parts, name])
        rows.append((i, path, text))
    df = spark.createDataFrame(rows, "doc_id long, p string, text string").withColumns({c: F.lit("clash") for c in ("license", "dir", "own", "path", "header", "whole")})
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in scan_licenses(df, F.col("p")).collect()}
    want = _plain_inheritance([(i, p) for i, p, _ in rows], own)
    assert got == want
    assert sum(x[1] == "inherited" for x in want.values()) > 1000 and sum(x[1] == "none" for x in want.values()) > 100


def test_whole_texts_and_notices(spark):
    from maskwright.llm.licenses import whole_texts

    cc0 = whole_texts()["CC0-1.0"][0]
    rows = [(1, "a/terms.txt", cc0), (2, "a/b/x.c", "int x;"), (3, "c/page.txt", "junk line\nLicensed under CC BY 4.0."), (4, "c/y.c", "int y;"), (5, None, cc0), (6, "z.c", "int z;"), (7, "", "int w;")]
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p")).collect()}
    # a whole licence under any name is its directory's; a notice in a page, or a licence without a path, is nobody's
    assert got[1][:2] == ("CC0-1.0", "file") and got[2] == ("CC0-1.0", "inherited", "a")
    assert got[3][:2] == ("CC-BY-4.0", "header") and got[4] == (None, "none", None)
    assert got[5][:2] == ("CC0-1.0", "file") and got[6] == (None, "none", None) == got[7]


def test_documents_inherit_nothing(spark):
    """The given documents hold no licence files."""
    origins = {r.origin for r in Q.op10_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert origins == {"header", "none"}


def test_no_files(spark):
    df = spark.createDataFrame([], "doc_id long, p string, text string")
    assert scan_licenses(df, F.col("p")).collect() == []

"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance by directory.

Words of the templates are counted over all texts for their inverse document frequency. Every line and every paragraph
of a text (a header) and the whole text (of a licence file) is a sparse vector; words that no template holds
lengthen it as if they were the rarest. The nearest template counts from a cosine of ``LEAST`` on. A licence file is
one by its name, or one whose whole text is near a whole licence; it gives its licence to its directory. A notice in any
other text is that text's own affair. A file without a header has the licence of the nearest directory above it, found by
joining the distinct directories' ancestors to the directories that have one.

Texts are read twice: once for the frequencies of all templates' words, once for the measures.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_rows import flat_bytes, in_arrow, slices
from .spark_util import cut, small_side
from .words import Words

#: Least cosine of a header and of a licence file to a template.
LEAST = 0.6
#: Fewest words of a whole licence in a file whose name does not say so.
LEAST_WORDS = 60
#: Names of licence files.
FILES = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.\-_].*)?$"
#: Identifiers and customary notices of public licences.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-2.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: A text near the first and near a notice of the second has the second: it is the first with a clause more.
MORE = ("BSD-2-Clause", "BSD-3-Clause")


def whole_texts() -> dict[str, list[str]]:
    """Licence files by identifier. Read by the driver only: workers get what ``Templates`` makes of them."""
    return {p.stem: [p.read_text("utf-8")] for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


#: Letters, digits and bytes of other scripts stay (A-Z lower-cased), ``-`` and ``.`` inside words too; the rest parts words.
_CLEAN = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256), 45]:
    _CLEAN[_b] = _b
for _b in range(65, 91):
    _CLEAN[_b] = _b + 32
_CLEAN[10] = 10


def _words(part: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
    """Cleaned words of all texts, the line of each word, and the paragraph of each word."""
    flat, offsets = flat_bytes(part, "text")
    flat = _CLEAN[flat]
    words = Words(flat, offsets)
    breaks = np.union1d(np.flatnonzero(flat == 10), offsets[1:-1])
    line = np.searchsorted(breaks, words.start, "right")
    # a paragraph ends where a text does or a line without words lies between words
    if len(words):
        gap = np.append(False, (np.diff(line) > 1) | (np.diff(words.text) > 0))
        return words, line, np.cumsum(gap)
    return words, line, line


class Templates:
    """Word hashes of the templates and their counts."""

    def __init__(self, templates: dict[str, list[str]]):
        pairs = [(name, text) for name, texts in templates.items() for text in texts]
        self.names = [n for n, _ in pairs]
        words, _, _ = _words(pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in pairs], pa.string())}))
        self.vocabulary = np.unique(words.hash)
        self.counts = np.zeros((len(pairs), len(self.vocabulary)))
        np.add.at(self.counts, (words.text, np.searchsorted(self.vocabulary, words.hash)), 1)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def _nearest(number: np.ndarray, span: np.ndarray, templates: Templates, idf: np.ndarray, rarest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that share a word with a template: their number, nearest template and cosine."""
    known = number >= 0
    hit, per = np.unique(span[known], return_inverse=True)
    if not len(hit):
        return hit, hit, np.zeros(0)
    cell, times = np.unique(per * len(idf) + number[known], return_counts=True)
    row, word = cell // len(idf), cell % len(idf)
    weight = times * idf[word]
    unknown = np.bincount(span[~known], minlength=int(hit[-1]) + 1)[hit] * rarest**2
    square = np.bincount(row, weight**2, minlength=len(hit)) + unknown
    models = templates.counts * idf
    models /= np.linalg.norm(models, axis=1, keepdims=True)
    best, cosine = np.zeros(len(hit), np.int64), np.full(len(hit), -1.0)
    for t, model in enumerate(models):
        own = np.bincount(row, weight * model[word], minlength=len(hit)) / np.sqrt(square)
        better = own > cosine + 1e-12
        best[better], cosine[better] = t, own[better]
    return hit, best, cosine


def _frequencies(rows: DataFrame, *kinds: Templates) -> tuple[int, list[np.ndarray]]:
    """How many texts there are, and how many hold each template word, for each kind of templates."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = [np.zeros(len(k.vocabulary), np.int64) for k in kinds], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words, _, _ = _words(part)
                for k, total in zip(kinds, totals, strict=True):
                    number = k.number(words.hash)
                    cells = np.unique(words.text[number >= 0] * len(total) + number[number >= 0])
                    total += np.bincount(cells % len(total), minlength=len(total))
                n += part.num_rows
        flat = np.concatenate(totals)
        yield pa.RecordBatch.from_pydict({"word": pa.array([-1, *range(len(flat))], pa.int64()), "n": pa.array([n, *flat.tolist()], pa.int64())})

    found = {r.word: r.n for r in in_arrow(rows.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    ends = np.cumsum([len(k.vocabulary) for k in kinds])
    flat = np.array([found.get(i, 0) for i in range(int(ends[-1]))])
    return found.get(-1, 0), np.split(flat, ends[:-1])


def directory(path: Column) -> Column:
    """All before the last slash; the empty path is the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def _headers(words: Words, spans: tuple[np.ndarray, ...], n: int, known: Templates, idf: np.ndarray, rarest: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` texts, the template nearest to one of the spans, and its cosine (of ties the first template)."""
    number = known.number(words.hash)
    fewer, more = ([i for i, x in enumerate(known.names) if x == name] for name in MORE)
    best, cosine, further = np.full(n, -1), np.full(n, -1.0), np.zeros(n, bool)
    for span in spans:
        hit, nearest, own = _nearest(number, span, known, idf, rarest)
        if not len(hit):
            continue
        of = words.text[np.searchsorted(span, hit)]
        further[of[np.isin(nearest, more) & (own >= least)]] = True
        order = np.lexsort((nearest, -np.round(own, 9), of))
        of, nearest, own = of[order], nearest[order], own[order]
        lead = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        of, nearest, own = of[lead], nearest[lead], own[lead]
        better = own > cosine[of] + 1e-9
        best[of[better]], cosine[of[better]] = nearest[better], own[better]
    if more:
        best[np.isin(best, fewer) & further] = more[0]
    return best, cosine


def _measures(rows: DataFrame, kind: str, templates: dict[str, list[str]] | None, least: float) -> DataFrame:
    """``doc_id, path`` with the nearest template and its cosine: of a line or paragraph (``header``), of the whole text
    among notices (``notice``) and among whole licences (``whole``, with ``n_words``)."""
    known = Templates(templates or TEMPLATES)
    # with a vocabulary of their own, whole licences leave the measure of headers as it is
    texts = None if templates else Templates(whole_texts())
    kinds = (known,) if texts is None else (known, texts)
    n, held = _frequencies(rows, *kinds)
    idfs, rarest = [np.log((n + 1) / (h + 1)) + 1 for h in held], float(np.log(n + 1) + 1)
    columns = ["header", "cosine", "notice", "notice_cosine", "whole", "whole_cosine"]

    def named(names: list[str], at: np.ndarray, cosine: np.ndarray) -> list[pa.Array]:
        found = [names[a] if c >= least else None for a, c in zip(at.tolist(), cosine.tolist(), strict=True)]
        return [pa.array(found, pa.string()), pa.array(np.round(np.maximum(cosine, 0), 9))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, line, paragraph = _words(part)
                m = part.num_rows
                found = named(known.names, *_headers(words, (line, paragraph), m, known, idfs[0], rarest, least))
                for k, idf in zip(kinds, idfs, strict=True):
                    at, measure = np.full(m, -1), np.full(m, -1.0)
                    hit, nearest, own = _nearest(k.number(words.hash), words.text, k, idf, rarest)
                    at[hit], measure[hit] = nearest, own
                    found += named(k.names, at, measure)
                if texts is None:
                    found += named([], np.full(m, -1), np.full(m, -1.0))
                size = pa.array(np.bincount(words.text, minlength=m).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found, size], names=["doc_id", "path", *columns, "n_words"])

    shape = f"doc_id {kind}, path string, header string, cosine double, notice string, notice_cosine double, whole string, whole_cosine double, n_words long"
    return in_arrow(rows, scan, shape)


def _inherited(found: DataFrame) -> DataFrame:
    """``dir, up`` (``given, at``): of each directory, the licence of the nearest one at or above it that has a file."""
    base = F.regexp_extract("path", r"(?s)([^/]*)$", 1)
    nearness = F.struct(F.col("own").isNull(), -F.greatest("own_cosine", "cosine"), base, F.coalesce("own", "header"))
    files = found.where("is_file AND dir IS NOT NULL").groupBy("dir").agg(F.min_by(F.coalesce("own", "header"), nearness).alias("given"))
    # a directory's ancestors: itself, then with one part less each time, down to the root
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = found.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth"), parts.alias("parts"))
    above = above.select("dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("at"))
    return above.join(small_side(files.withColumnRenamed("dir", "at")), "at").groupBy("dir").agg(F.max_by(F.struct("given", "at"), "depth").alias("up"))


def scan_licenses(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """One row per input row: ``doc_id, path, header_license, cosine, license, origin, from_dir``.

    ``header_license`` is the template nearest to a line or paragraph, ``cosine`` its measure (rounded to 9 places; of
    ties the first in the table of templates). ``license`` is what a licence file's whole text is nearest to (``origin``
    file) where that is nearer than its header, else that of the header (``header``), else of the nearest directory at
    or above the file that has a licence file (``inherited``, ``from_dir`` names it), else null (``none``).

    Files are licence files by their name, with a header or a whole text near a template, or by a whole text of
    ``LEAST_WORDS`` words or more that is near a whole licence. Of several in a directory whole texts come before
    headers, then the nearest, then the first by name. The root is the empty directory; rows without a path are in no
    directory, so they neither give nor inherit. Null texts are empty. No rows give no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), path.cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = F.regexp_extract("path", r"(?s)([^/]*)$", 1)
    # of notices and whole licences the nearer, of equals the notice
    nearer = F.when(F.col("whole").isNotNull() & (F.col("whole_cosine") > F.col("notice_cosine")), F.col("whole")).otherwise(F.coalesce("notice", "whole"))
    by_name = F.coalesce(base.rlike(FILES), F.lit(False)) & F.coalesce("whole", "notice", "header").isNotNull()
    by_text = F.col("whole").isNotNull() & (F.col("n_words") >= LEAST_WORDS)
    found = _measures(rows, kind, templates, least).withColumn("dir", directory(F.col("path"))).withColumn("is_file", by_name | by_text)
    found = cut(found.withColumn("own", F.when(F.col("is_file"), nearer)).withColumn("own_cosine", F.greatest("whole_cosine", "notice_cosine")))
    out = found.join(small_side(_inherited(found)), "dir", "left")
    as_file = F.col("own").isNotNull() & (F.col("own_cosine") > F.col("cosine"))
    license = F.when(as_file, F.col("own")).otherwise(F.coalesce("header", "up.given"))
    origin = F.when(as_file, "file").when(F.col("header").isNotNull(), "header").when(F.col("up").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.col("header").alias("header_license"), "cosine", license.alias("license"), origin.alias("origin"), F.when(origin == "inherited", F.col("up.at")).alias("from_dir"))

"""Token counts by a map-side two-tier lookup, without shuffling pre-tokens.

A piece vocabulary in which no piece holds a space mark after another letter, nor a line feed beside anything, can
be applied to each pre-token alone: spaces with the word behind them, or a line feed with the word behind it.
Tier one is a broadcast table of the lengths of frequent pre-tokens; tier two a bounded cache in each worker,
filled by encoding the distinct misses of a slice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import in_arrow, slices, texts_of, with_column

#: Pre-tokens in the broadcast table, at most this long: its size is bounded.
TABLE_WORDS, WORD_CHARS = 1 << 16, 64
#: Texts that are looked at for the table, tasks that do so, and the counter that each keeps.
SAMPLE_ROWS, SAMPLE_TASKS, COUNTER_WORDS = 4096, 8, 200_000
#: Misses that a worker remembers, at most CACHE_CHARS long; beyond this many it starts afresh.
CACHE_WORDS, CACHE_CHARS = 400_000, 256

SPACED = re.compile(r" +[^ \n]*|\n[^ \n]*")


def pre_tokens(text: str) -> list[str]:
    """The parts of ``text`` that are encoded alone, as strings whose encoding gives their length (see ``lengths``)."""
    if not text:
        return []
    text = text.replace("▁", " ")  # the model takes either as the space mark
    if "  " not in text and text[0] != " ":
        return text.replace("\n", " \n").split(" ")
    return [p[1:] if p[0] == " " else p for p in SPACED.findall(" " + text)]


class Pieces:
    """A piece model whose pre-tokens can be encoded alone; refuses others."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") or re.match("▁▁+[^▁]", p) or "\n" in p for p in pieces):
            raise ValueError("pieces of this model reach over pre-tokens")
        #: Tier one, and a copy of it that tier two adds to.
        self.table: dict[str, int] = {}
        self.cache: dict[str, int] = {}

    def lengths(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token. The library puts a space mark before each; one after a line feed has none."""
        found = self.model.encode(words, num_threads=1)
        return [1 if not w else len(ids) - (w[0] == "\n") for w, ids in zip(words, found, strict=True)]

    def count(self, texts: list[str], table: dict[str, int]) -> list[int]:
        split = [pre_tokens(t) for t in texts]
        if self.table is not table:  # the first tier; misses are added to it as the second
            self.table, self.cache, self.added = table, table, []
        missing = {w for words in split for w in set(words) if w not in self.cache}
        if len(self.added) + len(missing) > CACHE_WORDS:
            for w in self.added:
                self.cache.pop(w, None)
            self.added = []
            missing = {w for words in split for w in set(words) if w not in self.cache}
        new = list(missing)
        self.added += new
        self.cache.update(zip(new, self.lengths(new), strict=True))
        look = self.cache.__getitem__
        counts = [sum(map(look, words)) for words in split]
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.cache[w]
        return counts


@lru_cache(maxsize=4)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


_TABLES: dict[int, dict[str, int]] = {}


def _table(shared: Broadcast) -> dict[str, int]:
    """The broadcast table as a dict, built once in a worker."""
    if shared.value["key"] not in _TABLES:
        _TABLES.clear()
        words = shared.value["words"].decode().split(" ") if len(shared.value["lengths"]) else []
        _TABLES[shared.value["key"]] = dict(zip(words, shared.value["lengths"].tolist(), strict=True))
    return _TABLES[shared.value["key"]]


def frequent_pre_tokens(df: DataFrame, text_col: str = "text", size: int = TABLE_WORDS, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The most frequent pre-tokens of a random sample of about ``sample_rows`` texts. They only save time: whatever is
    not among them is encoded where it occurs. The sample's tasks each give a bounded list, which the driver merges."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch, text_col):
                for text in texts_of(part, text_col):
                    seen.update(pre_tokens(text))
                if len(seen) > COUNTER_WORDS:  # lossy counting: rare words go, frequent ones stay
                    low = int(np.median(np.fromiter(seen.values(), np.int64, len(seen))))
                    seen = Counter({w: n - low for w, n in seen.items() if n > low})
        top = [(w, n) for w, n in seen.most_common(size) if len(w) <= WORD_CHARS and " " not in w]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    sample = df.select(text_col).where(F.rand(11) < min(1.0, sample_rows / max(df.count(), 1))).repartition(SAMPLE_TASKS)
    total: Counter = Counter()
    for r in in_arrow(sample, propose, "word string, n long").toLocalIterator():
        total[r.word] += r.n
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


def count_tokens(df: DataFrame, path: str, text_col: str = "text", count_col: str = "n_tokens", drop: bool = False) -> DataFrame:
    """``df`` (without its text if ``drop``) with ``count_col``: the tokens of the whole text.

    As the library's ``encode`` counts them, without begin or end tokens. Null and empty texts have 0. Other columns
    stay; one named ``count_col`` is replaced. An empty table gives an empty table. ``path`` must exist on the workers.
    """
    words = frequent_pre_tokens(df, text_col)
    lengths = Pieces(path).lengths(words)
    shared = df.sparkSession.sparkContext.broadcast({"key": hash((path, tuple(words))), "words": " ".join(words).encode(), "lengths": np.array(lengths, np.uint16)})
    return with_column(df, text_col, count_col, "long", lambda texts: _pieces(path).count(texts, _table(shared)), drop=drop)

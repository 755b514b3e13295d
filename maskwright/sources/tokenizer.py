"""Morphemes of a text: the cheapest path through a lattice of dictionary words.

A dictionary is made of tables that the user gives: words with their cost and the numbers of their left and right
context, and the cost of each right context before each left one. Characters that no word explains form unknown words by
their class. Without tables the classes alone part a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..operators.trie import Trie
from .units import SYMBOLS, TOKEN, WORDS

#: A table of words, and one of contexts' costs; contexts that it does not name cost nothing. Context 0 is the text's border.
WORD_SCHEMA = "surface string, left_id int, right_id int, cost int, pos string, pos_detail_1 string, pos_detail_2 string"
CONNECTION_SCHEMA = "right_id int, left_id int, cost int"
#: Characters of a dictionary's words, and costs of contexts, at most: both are broadcast.
MOST_CHARS, MOST_CONTEXTS = 1 << 24, 1 << 24
#: Characters of texts that are looked up at once.
TOGETHER = 1 << 16


@dataclass(frozen=True)
class Kind:
    """Unknown words of a class of characters: ``always`` also beside known words, a whole run of the class at once
    (``group``), and beginnings of it up to ``length`` characters."""

    name: str
    pos: str
    detail: str
    cost: int
    always: bool = False
    group: bool = True
    length: int = 0


# Classes of characters, and their ranges of code points; of several the last counts.
KINDS = (
    Kind("blank", "記号", "空白", 100), Kind("digit", "名詞", "数", 2000, always=True), Kind("latin", "名詞", "固有名詞", 4000, always=True), Kind("hiragana", "名詞", "一般", 8000, length=2),
    Kind("katakana", "名詞", "一般", 5000, always=True, length=2), Kind("kanji", "名詞", "一般", 7000, group=False, length=2), Kind("symbol", "記号", "一般", 3000, always=True, group=False, length=1), Kind("other", "名詞", "一般", 6000),
)
RANGES = (
    ("symbol", "!-/:-@[-`{-~¡-¿、-〿！-／：-＠［-｀｛-･‐-⁞→-⇿■-◿"), ("blank", "\t\n\x0b\f\r \u00a0\u3000"), ("digit", "0-9０-９"), ("latin", "A-Za-zＡ-Ｚａ-ｚÀ-ÖØ-öø-ɏ"), ("hiragana", "ぁ-ゖゝゞ"), ("katakana", "ァ-ヺーヽヾｦ-ﾟ"),
    ("kanji", "一-鿿㐀-䶿々〆"),
)


def _class_table() -> np.ndarray:
    """The class of each code point of the first plane, and of all others."""
    names = [k.name for k in KINDS]
    out = np.full((1 << 16) + 1, names.index("other"), np.int8)
    for name, chars in RANGES:
        i = 0
        while i < len(chars):
            wide = chars[i + 1 : i + 2] == "-" and i + 2 < len(chars)
            out[ord(chars[i]) : ord(chars[i + 2] if wide else chars[i]) + 1] = names.index(name)
            i += 3 if wide else 1
    return out


class Dictionary:
    """Words by trie, costs of contexts, and unknown words. ``words`` are rows of ``WORD_SCHEMA``, ``connections`` of
    ``CONNECTION_SCHEMA`` (of several costs of the same contexts the last counts)."""

    def __init__(self, words: list[tuple] = (), connections: list[tuple] = ()):
        self.entries: dict[str, list[tuple]] = {}
        for surface, left, right, cost, *pos in words:
            if surface:
                self.entries.setdefault(surface, []).append((left or 0, right or 0, cost or 0, *pos))
        self.surfaces = sorted(self.entries)
        self.trie = Trie(self.surfaces)
        self.costs = {(r, left): cost for r, left, cost in connections}
        self.classes = _class_table()

    def _unknown(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The class of each character and where its run of the class ends."""
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 1 << 16)
        kind = self.classes[codes]
        last = np.append(np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(kind))
        return kind, last[np.searchsorted(last, np.arange(len(kind)), "right")]

    def lattice(self, text: str, found: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int, str, tuple]]:
        """Start, end, whether known, and entry of every word that may stand in a text, by start. ``found`` are the trie's
        matches in it, where they are known."""
        start, length, word = (x.tolist() for x in (self.trie.matches(text) if found is None else found))
        kind, run = (x.tolist() for x in self._unknown(text)) if text else ([], [])
        k = 0
        for i in range(len(text)):
            known = False
            while k < len(start) and start[k] == i:
                known = True
                for entry in self.entries[self.surfaces[word[k]]]:
                    yield i, i + length[k], "KNOWN", entry
                k += 1
            of = KINDS[kind[i]]
            if known and not of.always:
                continue
            ends = {min(i + n, run[i]) for n in range(1, of.length + 1)} | ({run[i]} if of.group or not of.length else set())
            for end in sorted(ends):
                yield i, end, "UNKNOWN", (0, 0, of.cost, of.pos, of.detail, "*")

    def tokenize_all(self, texts: list[str | None]) -> Iterator[list[dict]]:
        """``tokenize`` of each text; many are looked up in the trie at once."""
        group: list[str] = []
        size = 0
        for text in texts:
            if group and size + len(text or "") > TOGETHER:
                yield from self._together(group)
                group, size = [], 0
            group.append(text or "")
            size += len(group[-1])
        yield from self._together(group)

    def _together(self, texts: list[str]) -> Iterator[list[dict]]:
        gap = np.zeros(1, np.int32)  # a character of no word
        chars = [x for t in texts for x in (self.trie.numbers(t), gap)]
        start, length, word = self.trie.matches_in(np.concatenate([gap, *chars])[1:])
        begin = 0
        for text in texts:
            a, b = np.searchsorted(start, [begin, begin + len(text)])
            yield self.tokenize(text, (start[a:b] - begin, length[a:b], word[a:b]))
            begin += len(text) + 1

    def tokenize(self, text: str, found: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[dict]:
        """The words of the cheapest path, as fields of ``TOKEN``. Of paths of equal cost the one found first counts:
        from left to right, shorter words before longer ones, known before unknown, in the table's order."""
        if not text:
            return []
        # of each place, the cheapest way to arrive there with each right context: its cost and last word
        best: list[dict[int, tuple[int, tuple | None]]] = [{} for _ in range(len(text) + 1)]
        best[0][0] = 0, None
        costs = self.costs
        for start, end, known, entry in self.lattice(text, found):
            arrived = best[start]
            if not arrived:
                continue
            left, right, own = entry[:3]
            least, before = None, None
            for context, (spent, last) in arrived.items():
                total = spent + costs.get((context, left), 0)
                if least is None or total < least:
                    least, before = total, last
            total, there = least + own, best[end]
            if right not in there or total < there[right][0]:
                there[right] = total, (start, end, known, entry, before)
        _, last = min(((spent + costs.get((context, 0), 0), last) for context, (spent, last) in best[-1].items()), key=lambda x: x[0])
        path = []
        while last is not None:
            path.append(last)
            last = last[4]
        return [
            {"surface_form": text[a:b], "pos": entry[3], "pos_detail_1": entry[4], "pos_detail_2": entry[5], "word_type": known, "word_position": a + 1}
            for a, b, known, entry, _ in reversed(path)
        ]


def dictionary_of(words: DataFrame, connections: DataFrame | None = None) -> Dictionary:
    """The dictionary of tables (``WORD_SCHEMA``, ``CONNECTION_SCHEMA``). Sizes are counted before anything is fetched; a
    dictionary beyond the bounds is an error. Words are taken by surface, contexts and cost, so their order does not matter."""
    columns = [c.split()[0] for c in WORD_SCHEMA.split(", ")]
    chars = words.agg(F.coalesce(F.sum(F.length("surface")), F.lit(0))).first()[0]
    pairs = connections.count() if connections is not None else 0
    if chars > MOST_CHARS or pairs > MOST_CONTEXTS:
        raise ValueError(f"a dictionary of {chars} characters and {pairs} pairs of contexts is too large to broadcast")
    rows = words.where("surface <> ''").select(columns).distinct().orderBy("surface", "cost", *columns[1:3], *columns[4:]).collect()
    costs = connections.groupBy("right_id", "left_id").agg(F.min("cost")).collect() if connections is not None else []
    return Dictionary([tuple(r) for r in rows], [tuple(r) for r in costs])


def with_dictionary_tokens(lines: DataFrame, dictionary: Dictionary, text: Column | None = None) -> DataFrame:
    """``lines`` with ``tokens`` of a dictionary. ``text`` is the line's text unless its symbols (``words``) hold it; null and
    empty texts have no tokens. The dictionary is broadcast once."""
    ship(lines.sparkSession)
    shared = lines.sparkSession.sparkContext.broadcast(dictionary)
    if text is None:
        symbols = F.flatten(F.transform(F.col("words").cast(WORDS), lambda w: F.coalesce(w["symbols"], F.array().cast(SYMBOLS))))
        text = F.array_join(F.transform(symbols, lambda s: s["text"]), "")

    @F.pandas_udf(f"array<{TOKEN}>")
    def tokens(texts):
        return type(texts)(list(shared.value.tokenize_all(texts.tolist())), index=texts.index, dtype=object)

    # marked so, texts are parted once, however often the tokens are read or filtered by
    return lines.withColumn("tokens", tokens.asNondeterministic()(text))

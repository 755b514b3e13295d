"""BPE encoding and decoding with a public vocabulary, by batched numpy merge rounds.

The words of a slice of texts that the worker has not met are encoded together: all their symbols lie in one
flat array, and each round looks every adjacent pair up by binary search over the sorted pair keys, merges each
word's lowest-ranked pair wherever it stands, and drops words that are finished.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrow_rows import with_column

#: Distinct words whose ids a worker remembers; beyond this it starts afresh.
CACHE_WORDS = 50_000
#: Symbols that are merged together in one flat array.
ROUND_SYMBOLS = 1 << 18
NO_RANK = np.iinfo(np.int64).max
#: Words of more bytes are merged one by one, with work in proportion to what changes in a round.
LONG_WORD = 1024

# The tokenizers library splits by the letters and numbers of Unicode 16 and lower-cases by Unicode 17.
# Ranges that are letters or numbers since Unicode 17, and the capitals that Unicode 15.1 does not hold, with the
# distance to their small letters.
NEW_LETTERS = (
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NEW_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
NEW_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))


def _set(ranges: tuple[tuple[int, int], ...]) -> str:
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


_LOWER = {c: c + step for a, b, step in NEW_CAPITALS for c in range(a, b + 1)}
_CAPITALS = regex.compile("[" + "".join(map(chr, _LOWER)) + "]")
_NEW = regex.compile("|".join(map(_set, (NEW_LETTERS, NEW_NUMBERS))))


def _of_unicode_16(pattern: str) -> regex.Pattern:
    """``pattern`` with the letters and numbers of Unicode 16, whatever version the package holds."""
    for name, newer in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
        pattern = pattern.replace(f"\\p{{{name}}}", f"[\\p{{{name}}}--{_set(newer)}]")
    return regex.compile(pattern, regex.V1)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class BytePairs:
    """A byte-level BPE of a tokenizers file: NFC and lower case, words by pattern, word ends as suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        steps = json.dumps(spec.get("normalizer"))
        self.nfc, self.lower = '"NFC"' in steps, '"Lowercase"' in steps
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.words_16 = _of_unicode_16(split["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made_of = keys[order], order, made[order]
        # A symbol must exist before a pair that holds it is merged; then all places of a pair can merge at once.
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(born, made, np.arange(len(made)))
        self.at_once = bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.added.items()}
        self.token_bytes = [strings.get(i, "").encode() for i in range(max(strings) + 1)]
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str | int]:
        """The words of ``text``; added tokens as their ids."""
        if not any(token in text for token in self.added):
            return self._split_plain(text)
        out: list[str | int] = []
        for part in self.added_split.split(text):
            out += [self.added[part]] if part in self.added else self._split_plain(part)
        return out

    def _split_plain(self, text: str) -> list[str]:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: the form of sigma does not depend on its place
            if not text.isascii() and _CAPITALS.search(text):
                text = text.translate(_LOWER)
        newer = not text.isascii() and _NEW.search(text)
        return (self.words_16 if newer else self.words).findall(text)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        out: dict[int, bytes] = {i: self._merge_long(w) for i, w in enumerate(raw) if len(w) > LONG_WORD}
        some: list[int] = []
        held = 0
        for i, w in enumerate(raw):
            if i in out:
                continue
            if held and held + len(w) > ROUND_SYMBOLS:
                out.update(zip(some, self._merge_flat([raw[k] for k in some]), strict=True))
                some, held = [], 0
            some.append(i)
            held += len(w)
        if some:
            out.update(zip(some, self._merge_flat([raw[k] for k in some]), strict=True))
        return [out[i] for i in range(len(raw))]

    def _merge_long(self, word: bytes) -> bytes:
        """The ids of one long word: symbols as a linked list in arrays, places filed by the rank of their pair.

        A round takes the places of the lowest rank; only they and the places before them are ranked anew.
        """
        flat, n = np.frombuffer(word, np.uint8), len(word)
        symbols = np.append(self.inner[flat[:-1]], self.last[flat[-1:]])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, made = np.full(n, NO_RANK), np.zeros(n, np.int64)
        marked = np.zeros(n + 1, bool)
        files: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(at: np.ndarray) -> None:
            own = at[after[at] < n]
            rank[at] = NO_RANK
            key = symbols[own] << 32 | symbols[after[own]]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            is_pair = self.keys[found] == key
            own, found = own[is_pair], found[is_pair]
            rank[own], made[own] = self.rank_of[found], self.made_of[found]
            own = own[np.argsort(rank[own], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[own])) + 1
            for part in np.split(own, cuts) if len(own) else ():
                r = int(rank[part[0]])
                if r not in files:
                    files[r] = []
                    heappush(heap, r)
                files[r].append(part)

        file(np.arange(n))
        while heap:
            r = heappop(heap)
            at = np.unique(np.concatenate(files.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.at_once:  # of overlapping places every other one, from the left
                marked[at] = True
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(marked[before[at]], 0, place))
                marked[at] = False
                at = at[(place - run) % 2 == 0]
            elif len(at) > 1:
                files[r] = [at[1:]]
                heappush(heap, r)
                at = at[:1]
            gone = after[at]
            symbols[at], rank[gone] = made[at], NO_RANK
            after[at] = after[gone]
            linked = at[after[at] < n]
            before[after[linked]] = linked
            symbols[gone] = -1
            earlier = before[at]
            file(np.unique(np.append(at, earlier[earlier >= 0])))
        return symbols[symbols >= 0].astype("<u4").tobytes()

    def _merge_flat(self, raw: list[bytes]) -> list[bytes]:
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(w) for w in raw], np.int64)
        ends = np.cumsum(sizes)
        symbols, word = self.inner[flat], np.repeat(np.arange(len(raw)), sizes)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self._ranks(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            over = lowest == NO_RANK
            if over.any():
                done.append((word[over], symbols[over]))
                symbols, word, rank, made, lowest = (x[~over] for x in (symbols, word, rank, made, lowest))
                if not len(symbols):
                    break
            hit = rank == lowest
            if self.at_once:  # of overlapping places every other one, from the left
                place = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
                hit &= (place - run) % 2 == 0
            else:  # the leftmost of each word
                found = np.flatnonzero(hit)
                hit = np.zeros_like(hit)
                hit[found[np.append(True, word[found][1:] != word[found][:-1])]] = True
            symbols[hit] = made[hit]
            keep = ~np.append(False, hit[:-1])
            symbols, word, rank, made, hit = (x[keep] for x in (symbols, word, rank, made, hit))
            # only pairs that hold a new symbol need a new rank
            changed = np.flatnonzero(hit | np.append(hit[1:], False))
            rank[changed], made[changed] = self._ranks(symbols, word, changed)
        word, symbols = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        data = symbols[order].astype("<u4").tobytes()
        cuts = (np.append(0, np.cumsum(np.bincount(word, minlength=len(raw)))) * 4).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that begin ``at`` these places, by binary search over the sorted keys."""
        after = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] << 32 | symbols[after]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        is_pair = (self.keys[found] == key) & (word[at] == word[after]) & (after > at)
        return np.where(is_pair, self.rank_of[found], NO_RANK), self.made_of[found]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        new = {w for words in split for w in set(words) if w not in self.cache}
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = {w for words in split for w in words}
        fresh = sorted(w for w in new if isinstance(w, str))
        self.cache.update(zip(fresh, self.merge(fresh), strict=True))
        self.cache.update((i, i.to_bytes(4, "little")) for i in self.added.values())
        look = self.cache.__getitem__
        return [b"".join(map(look, words)) for words in split]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """As the library without a decoder: the token strings, joined by one space. Unknown ids give nothing."""
        known, out = self.token_bytes, []
        for p in packed:
            ids = np.frombuffer(p, "<u4")
            out.append(b" ".join(map(known.__getitem__, ids[ids < len(known)].tolist())))
        return out


@lru_cache(maxsize=4)
def _model(path: str) -> BytePairs:
    """One model for a worker process, kept between tasks."""
    return BytePairs(path)


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", drop: bool = False) -> DataFrame:
    """``df`` (without its text if ``drop``) with ``ids_col``: the token ids of the whole text as packed little-endian unsigned 32-bit integers.

    Null and empty texts give no ids. Strings of the vocabulary's added tokens are those tokens. Other columns stay;
    one named ``ids_col`` is replaced. An empty table gives an empty table. ``path`` must exist on the workers.
    """
    return with_column(df, text_col, ids_col, "binary", lambda texts: _model(path).encode(texts), drop=drop)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text of the packed ids. Null and empty ids give the empty text; other columns stay."""
    return with_column(df, ids_col, text_col, "string", lambda packed: [x.decode() for x in _model(path).decode(packed)], strings=False)


def bpe_round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", drop: bool = False) -> DataFrame:
    """``bpe_encode`` and ``bpe_decode`` in one pass, so that a task has one Python worker with one vocabulary."""

    def both(texts: list[str]) -> pa.Array:
        model = _model(path)
        packed = model.encode(texts)
        return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(model.decode(packed), pa.binary()).cast(pa.string())], names=["ids", "decoded"])

    kept = [c for c in df.columns if c not in (ids_col, decoded_col, "_coded") and not (drop and c == text_col)]
    coded = with_column(df.select(*kept, *([text_col] if text_col not in kept else [])), text_col, "_coded", "struct<ids:binary,decoded:string>", both, drop=drop, limit=1 << 18)
    return coded.select(*kept, coded["_coded.ids"].alias(ids_col), coded["_coded.decoded"].alias(decoded_col))

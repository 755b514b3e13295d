"""Words and word windows of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes that part words: space and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of one text that are hashed at once; cut between words.
PIECE_BYTES = 1 << 19
_SEED = np.random.default_rng(20240229)
_BYTE_VALUES = _SEED.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: Odd bases of the polynomials: bytes in a word, words in a window (two of those).
BASES = tuple(int(x) for x in _SEED.integers(1 << 40, 1 << 62, 3, np.uint64) * np.uint64(2) + np.uint64(1))


def _made_powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


#: Tables up to the size of a piece are kept, larger ones (a very long text's words) are made when needed.
_powers = lru_cache(maxsize=8)(_made_powers)


def _power(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64."""
    base = pow(base, -1, 1 << 64) if inverse else base
    size = 1 << max(16, (n - 1).bit_length())
    return (_powers if size <= PIECE_BYTES else _made_powers)(base, size)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _pieces(flat: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of at most PIECE_BYTES that end where a text or word ends; a longer word is a range of its own."""
    out, start, end = [], 0, len(flat)
    while end - start > PIECE_BYTES:
        near = flat[start : start + PIECE_BYTES]
        at = offsets[np.searchsorted(offsets, start + PIECE_BYTES, "right") - 1]
        gaps = np.flatnonzero(SPACE[near[-65536:]])
        if at > start:
            stop = int(at)
        elif len(gaps):
            stop = start + PIECE_BYTES - len(near[-65536:]) + int(gaps[-1]) + 1
        else:
            later = np.flatnonzero(SPACE[flat[start + PIECE_BYTES : end]])
            stop = start + PIECE_BYTES + int(later[0]) if len(later) else end
            following = offsets[np.searchsorted(offsets, start, "right")]
            stop = min(stop, int(following)) if following > start else stop
        out.append((start, stop))
        start = stop
    return [*out, (start, end)]


class Words:
    """The words of texts that lie one after another in ``flat``: ``start``, ``end``, ``text`` (row) and ``hash``."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, lower: bool = False):
        values = _BYTE_VALUES[_LOWER] if lower else _BYTE_VALUES
        starts, ends, hashes = [], [], []
        for a, b in _pieces(flat, offsets):
            data = flat[a:b]
            letter = ~SPACE[data]
            before, after = np.zeros_like(letter), np.zeros_like(letter)
            before[1:], after[:-1] = letter[:-1], letter[1:]
            cuts = offsets[(offsets > a) & (offsets < b)] - a
            before[cuts], after[cuts - 1] = False, False
            s, e = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * _power(BASES[0], len(data)), out=sums[1:]) if len(data) else None
            hashes.append(mix((sums[e] - sums[s]) * _power(BASES[0], max(len(data), 1), inverse=True)[s]) if len(s) else np.zeros(0, np.uint64))
            starts.append(s + a)
            ends.append(e + a)
        self.start, self.end, self.hash = (np.concatenate(x) for x in (starts, ends, hashes))
        self.text = np.searchsorted(offsets, self.start, "right") - 1

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, size: int, which: int = 0) -> np.ndarray:
        """Hash of the ``size`` words from each place; use only places that ``whole`` names."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        base = BASES[1 + which]
        sums = np.zeros(len(self) + 1, np.uint64)
        np.cumsum(self.hash * _power(base, len(self)), out=sums[1:])
        return mix((sums[size:] - sums[:n]) * _power(base, n, inverse=True))

    def whole(self, size: int) -> np.ndarray:
        """Places from which ``size`` words lie in one text."""
        n = len(self) - size + 1
        return np.flatnonzero(self.text[:n] == self.text[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

"""Words as a trie in flat arrays."""

from __future__ import annotations

import numpy as np


class Trie:
    """Distinct words whose prefixes are nodes, numbered level by level from the root 0.

    ``edges`` (node * width + character) are sorted, and the n-th leads to node n + 1. ``number`` gives a character's
    number by code point, 0 for those of no word. ``word`` is the place of the word that ends at a node, or -1.
    """

    def __init__(self, words: list[str]):
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        alphabet = np.unique(codes)
        self.depth, self.width = int(sizes.max(initial=0)), len(alphabet) + 1
        self.number = np.zeros(int(alphabet.max(initial=0)) + 2, np.int32)
        self.number[alphabet] = np.arange(1, self.width)
        chars = self.number[codes].astype(np.int64)
        node, edges, word, n = np.zeros(len(words), np.int64), [np.zeros(0, np.int64)], [np.full(1, -1, np.int64)], 1
        #: First node of each level and the one after its last.
        self.levels: list[tuple[int, int]] = []
        for depth in range(self.depth):
            alive = np.flatnonzero(sizes > depth)
            made, at = np.unique(node[alive] * self.width + chars[starts[alive] + depth], return_inverse=True)
            node[alive] = n + at
            ends = np.full(len(made), -1, np.int64)
            whole = sizes[alive] == depth + 1
            ends[at[whole]] = alive[whole]
            edges.append(made)
            word.append(ends)
            self.levels.append((n, n + len(made)))
            n += len(made)
        self.edges, self.word, self.size = np.concatenate(edges), np.concatenate(word), n

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's characters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.number[np.minimum(codes, len(self.number) - 1)]

    def children(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Where the edges from nodes by characters lead; 0 where there is none."""
        if not len(self.edges):
            return np.zeros(len(node), np.int64)
        key = node.astype(np.int64) * self.width + char
        edge = np.searchsorted(self.edges, key)
        return np.where(self.edges[np.minimum(edge, len(self.edges) - 1)] == key, edge + 1, 0)

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and place of every word that occurs in a text, by start and length."""
        return self.matches_in(self.numbers(text))

    def matches_in(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``matches`` of a text given by its characters' numbers."""
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        found = [(np.zeros(0, np.int64),) * 3]
        for depth in range(self.depth):
            inside = at + depth < len(chars)
            at, node = at[inside], node[inside]
            node = self.children(node, chars[at + depth])
            at, node = at[node > 0], node[node > 0]
            whole = self.word[node] >= 0
            found.append((at[whole], np.full(int(whole.sum()), depth + 1), self.word[node[whole]]))
        start, length, word = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((length, start))
        return start[order], length[order], word[order]

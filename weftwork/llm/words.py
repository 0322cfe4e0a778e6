"""Words and word shingles of many texts at once, as numpy arrays over their code points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
SHINGLE = 5


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """By code point: 1 for letters, 2 for other word characters (digits, marks within words, underscore), else 0."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = 1
        elif c.isalnum() or c == "_":
            table[i] = 2
    return table


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.ones(n, U64)
    if n > 1:
        out[1:] = _BASE
        np.multiply.accumulate(out, out=out)
    return out


def powers(n: int) -> np.ndarray:
    return _powers(1 << max(6, (n - 1).bit_length()))


def slices(texts: Sequence[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts with about `chars` code points; a longer text stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words (runs of letters, digits and underscore, lower-cased) of some texts.

    cp: code points of all texts; start, end: of each word in cp; doc: index of its text; first: index of
    the first word of each text, with one more entry for the end; hash: 64 bits a word.
    """

    def __init__(self, texts: Sequence[str], letters_only: bool = False):
        joined = "\n".join([t.lower() for t in texts]) + "\n"
        self.cp = cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = word_table()[cp]
        inside = (kind == 1) if letters_only else (kind > 0)
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(t.lower()) + 1 for t in texts], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.length = self.end - self.start
        self.has_letter = None
        if len(self.start):
            power = powers(int(self.length.max()))
            # within words only: position in the word gives the power
            n = int(self.length.sum())
            where = np.repeat(self.start - np.concatenate([[0], np.cumsum(self.length)[:-1]]), self.length) + np.arange(n)
            within = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(self.length)[:-1]]), self.length)
            terms = (cp[where].astype(U64) + U64(1)) * power[within]
            self.hash = mix(np.add.reduceat(terms, np.concatenate([[0], np.cumsum(self.length)[:-1]])))
        else:
            self.hash = np.zeros(0, U64)

    def prefixes(self, lengths: Sequence[int], suffix: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, indices of words longer than it, 64-bit hashes of their first or last code points)."""
        h = np.zeros(len(self.start), U64)
        power = powers(64)
        for j in range(1, max(lengths) + 1):
            at = np.flatnonzero(self.length > j)
            where = self.end[at] - j if suffix else self.start[at] + j - 1
            h[at] += (self.cp[where].astype(U64) + U64(1)) * power[j]
            if j in lengths:
                yield j, at, mix(h[at] + U64(j * 2 + suffix + 1))


def shingle_hashes(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text index) of every k-word shingle, in text order. A text of fewer than k words has
    one shingle of all its words; one without words has one fixed shingle."""
    n_docs = len(words.first) - 1
    n = np.diff(words.first)
    count = np.maximum(n - k + 1, 1)
    doc = np.repeat(np.arange(n_docs), count)
    out = np.zeros(len(doc), U64)
    at = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) + words.first[doc]
    padded = np.concatenate([words.hash, np.zeros(k, U64)])
    power = powers(k + 2)
    end = words.first[doc + 1]
    for j in range(k):
        out += np.where(at + j < end, padded[np.minimum(at + j, len(padded) - 1)] | U64(1), U64(0)) * power[j + 1]
    return mix(out), doc

"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes.

``WordBlock`` finds every word of a run of texts and gives each a 64-bit rolling
hash; n-gram and line hashes follow without touching Python strings.  Equal
words, n-grams and lines have equal hashes; different ones collide with a chance
of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Random weights of the 256 bytes, an odd base for positions and its inverse modulo 2**64.
_WEIGHT = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i for i up to n; only the largest pair is kept."""
    size = max(1 << 16, -(-int(n) >> 19) << 19)
    if not _powers or next(iter(_powers)) < size:
        both = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _powers.clear()
        _powers[size] = tuple(both)
    return next(iter(_powers.values()))


def forget_tables() -> None:
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Word hashes of a run of texts.

    words: the hashes in order; doc: the text of each word; counts: words of each
    text; those of text i are word_offsets[i] to word_offsets[i + 1].
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, counts
        self.word_offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(counts)), counts)

    def per_doc(self, by_word: np.ndarray) -> np.ndarray:
        """Sum a value of each word over each text."""
        total = np.zeros(len(by_word) + 1, np.int64)
        np.cumsum(by_word, out=total[1:])
        return np.diff(total[self.word_offsets])

    def windows(self, n: int) -> np.ndarray:
        """The first words of the windows of n words that lie inside one text."""
        if len(self.doc) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])

    def extend(self, grams: np.ndarray, n: int) -> np.ndarray:
        """From the rolled hashes of all windows of n - 1 words to those of n; windows may cross texts."""
        return grams[: max(0, len(self.words) - n + 1)] * _GRAM + self.words[n - 1 :]


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, limit: int = 1 << 20) -> Words:
    """The words alone, worked out over about ``limit`` bytes at a time (a longer text stands alone)."""
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        block = WordBlock(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], lower)
        words.append(block.words)
        counts.append(block.counts)
        start = stop
    return Words(np.concatenate(words), np.concatenate(counts))


class SpanHashes:
    """Hashes of any spans of a run of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self._inverse = _tables(n + 1)
        self._prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_WEIGHT[data] * power[:n], out=self._prefix[1:])

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        rolled = (self._prefix[ends] - self._prefix[starts]) * self._inverse[starts]
        return mix(rolled + (ends - starts).astype(np.uint64))


class WordBlock(Words, SpanHashes):
    """data: bytes of the texts end to end; offsets: where each begins, and the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        SpanHashes.__init__(self, data)
        Words.__init__(self, self.span_hash(self.starts, self.ends), np.diff(np.searchsorted(self.starts, offsets)))

    def characters(self) -> np.ndarray:
        """Code points before each byte."""
        seen = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=seen[1:])
        return seen

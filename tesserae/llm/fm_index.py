"""An FM-index over sequences of words: backward search on a wavelet matrix, for many patterns at once.

The words of all sequences are numbered and put one after the other, each sequence closed by a separator. The index
keeps their Burrows-Wheeler transform as a wavelet matrix, whose levels are bit vectors with counts by machine word,
so a word takes as many bits as the vocabulary needs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; the last symbol must be unlike all others."""
    n, rank, step = len(symbols), symbols.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (rank.max() + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth, self.levels = max(1, int(n_symbols - 1).bit_length()), []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(n_symbols)
        self.start = self._down(every, np.zeros(n_symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> level & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.start[symbol]


class FmIndex:
    """Of ``sequences`` of words; ``values``, one a sequence, are what a search brings back the least of."""

    def __init__(self, sequences: Sequence[Sequence[bytes]], values: np.ndarray):
        self.number: dict[bytes, int] = {}
        known = self.number
        codes = [known.setdefault(w, len(known) + 1) for s in sequences for w in s]  # 0 is the separator
        length = np.array([len(s) for s in sequences], np.int64)
        self.ends = np.cumsum(length + 1) - 1  # where the separators stand
        text = np.zeros(int(length.sum()) + len(length), np.int64)
        inside = np.ones(len(text), bool)
        inside[self.ends] = False
        text[inside] = codes
        self.text, n = text, len(sequences)
        symbols = np.where(inside, text + n, 0)
        symbols[self.ends] = np.arange(n)  # separators differ in the order of suffixes only
        order = suffix_array(symbols)
        self.matrix = WaveletMatrix(text[order - 1], len(known) + 1)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(known) + 1))])
        of = np.repeat(np.arange(n), length + 1)
        self.least = [np.asarray(values, np.int64)[of[order]]]

    def codes(self, words: Sequence[bytes]) -> np.ndarray:
        """Numbers of words; 0 for those that the index doesn't have."""
        return np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))

    def match(self, stream: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high): matching statistics of a stream of codes, and the interval of suffixes that begin with the match.

        The length is that of the longest match, of at most ``most`` words, whose last word stands at each of ``ends``.
        """
        length, low, high = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text))
        live = np.arange(len(ends))
        for back in range(most):
            live = live[ends[live] >= back]
            symbol = stream[ends[live] - back]
            live, symbol = live[symbol > 0], symbol[symbol > 0]
            both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            a, b = self.smaller[symbol] + both[: len(live)], self.smaller[symbol] + both[len(live) :]
            good = a < b
            live, a, b = live[good], a[good], b[good]
            low[live], high[live], length[live] = a, b, back + 1
            if not len(live):
                break
        return length, low, high

    def least_value(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of the sequences that the suffixes of each interval stand in."""
        power = np.frexp((high - low).astype(float))[1] - 1  # of two, the greatest that fits
        while len(self.least) <= power.max(initial=0):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))
        out = np.empty(len(low), np.int64)
        for p in np.unique(power):
            at = power == p
            out[at] = np.minimum(self.least[p][low[at]], self.least[p][high[at] - (1 << p)])
        return out

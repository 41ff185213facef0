"""An FM-index over a sequence of words: suffix order, wavelet tree with ranks, backward search, sampled positions.

A small helper of ``decontamination``: it holds one shard, whose size the caller bounds.  Symbol 0 stands at the end of each
document, words have the numbers from 1.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class Bits:
    """Bits with ranks: packed words, and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, dtype=np.uint8)]).view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.cumsum(ones, dtype=np.int64) - ones
        self.total = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before ``at``."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``symbols``, which end in 0; zeros differ from each other, earlier ones are smaller.

    Suffixes are sorted by a few symbols packed into a number; then, as long as some are equal, those alone are sorted by
    the ranks of what follows, so each round doubles the length that is compared.
    """
    n = len(symbols)
    ends = symbols == 0
    n_ends = int(ends.sum())
    value = symbols.astype(np.int64) + (n_ends - 1)
    value[ends] = np.arange(n_ends)
    width = int(value.max()).bit_length() or 1
    packed = max(1, min(62 // width, 6))
    key = value.copy()
    for j in range(1, packed):
        key <<= width
        key[: max(0, n - j)] |= value[j:]
    order = np.argsort(key)
    key = key[order]
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(key[1:], key[:-1], out=first[1:])
    del key
    rank = np.empty(n, dtype=np.int64)
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = starts
    alone = first & np.append(first[1:], True)
    place = np.flatnonzero(~alone)
    length = packed
    while len(place):
        rows = order[place]
        key = rank[rows] * n + rank[rows + length]
        by = np.argsort(key)
        rows, key = rows[by], key[by]
        order[place] = rows
        first = np.empty(len(place), dtype=bool)
        first[0] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        rank[rows] = place[np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))]
        alone = first & np.append(first[1:], True)
        place = place[~alone]
        length *= 2
    return order


class FmIndex:
    """The index of ``symbols`` (int array that ends in 0); phrases may have symbols up to ``n_symbols``."""

    def __init__(self, symbols: np.ndarray, n_symbols: int = 0):
        n = len(symbols)
        order = suffix_order(symbols)
        last = symbols[order - 1]  # the symbol before each suffix; before the first one stands the last, 0
        self.n, self.n_symbols = n, max(n_symbols, int(symbols.max(initial=0)) + 1)
        counts = np.bincount(symbols, minlength=self.n_symbols)
        self.less = np.cumsum(counts) - counts
        # positions are kept for every SAMPLE-th suffix and for those that begin a document, where a walk to the left ends
        kept = (order % SAMPLE == 0) | (last == 0)
        self.kept, self.positions = Bits(kept), order[kept]
        self.levels: list[tuple[int, Bits, int]] = []
        rest = last.astype(np.int32)
        for shift in range(max(1, (self.n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = (rest >> shift) & 1 > 0
            bits = Bits(bit)
            self.levels.append((shift, bits, n - bits.total))
            rest = np.concatenate([rest[~bit], rest[bit]])
        every = np.arange(self.n_symbols)
        self.base = self._walk(every, np.zeros(self.n_symbols, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``at`` taken down the tree along ``symbol``."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1 > 0, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at`` in the last column."""
        return self._walk(symbol, at) - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all ``phrases`` (rows of symbols, of which the first ``lengths`` count): those that occur, and their suffixes from and up to."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        found = []
        for step in range(1, phrases.shape[1] + 1):
            done = lengths[which] < step
            found.append((which[done], low[done], high[done]))
            which, low, high = which[~done], low[~done], high[~done]
            symbol = phrases[which, lengths[which] - step]
            ranks = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.less[symbol] + ranks[: len(which)], self.less[symbol] + ranks[len(which) :]
            left = low < high
            which, low, high = which[left], low[left], high[left]
        found.append((which, low, high))
        which, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        return which, low, high

    def locate(self, suffix: np.ndarray) -> np.ndarray:
        """Positions of suffixes: each walks to the left until one whose position is kept."""
        position = np.empty(len(suffix), dtype=np.int64)
        which, at, steps = np.arange(len(suffix)), suffix, 0
        while len(which):
            there = self.kept.get(at)
            position[which[there]] = self.positions[self.kept.rank(at[there])] + steps
            which, at = which[~there], at[~there]
            at, symbol = self._before(at)
            at = self.less[symbol] + at - self.base[symbol]
            steps += 1
        return position

    def _before(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbol before each suffix lands in the tree, and the symbol."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return at, symbol

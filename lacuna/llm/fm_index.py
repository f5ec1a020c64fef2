"""A compressed FM-index over word sequences, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class _Bits:
    """Bit vector with rank: packed words and a count before each."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        ones = np.bitwise_count(words).astype(np.uint32)
        self.before = np.cumsum(ones, dtype=np.uint32) - ones
        self.ones = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Symbols as one bit vector per bit, highest first; zeros move before ones at each level."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits: list[_Bits] = []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            self.bits.append(_Bits(bit.astype(bool)))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))
        self.size = len(symbols)
        every = np.arange(1 << self.levels)
        self.first = self._descend(every, np.zeros(len(every), dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bits, level in zip(self.bits, reversed(range(self.levels))):
            ones = bits.rank(at).astype(np.int64)
            at = np.where((symbol >> level) & 1, self.size - bits.ones + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.first[symbol]


def _sorted_suffixes(text: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and the ranks by the first ``keep`` symbols.

    ``keep`` is a power of two. Zeros end a sequence; each is unlike all others, so no
    match runs over one.
    """
    size = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    length, kept = 1, rank
    while True:
        if length == keep:
            kept = rank
        if rank.max() == size - 1:
            break
        follow = np.zeros(size, dtype=np.int64)
        follow[:size - length] = rank[length:] + 1
        key = rank * (size + 1) + follow
        order = np.argsort(key, kind="stable")
        steps = np.diff(key[order]) != 0
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(steps)))
        length *= 2
    if length < keep:
        kept = rank
    suffixes = np.empty(size, dtype=np.int64)
    suffixes[rank] = np.arange(size)
    return suffixes, kept


class FMIndex:
    """Index of a concatenation of sequences, each followed by a zero.

    ``owner`` gives a number for every symbol's sequence; ``longest`` is the length at which matches
    count, and longer ones are cut to it.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, longest: int):
        self.longest = longest
        short = longest - 1
        power = 1 << (max(1, short).bit_length() - 1)
        suffixes, ranks = _sorted_suffixes(text, power)
        self.tree = WaveletTree(text[suffixes - 1])
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 1)
        self.before = np.cumsum(counts) - counts
        # suffixes that agree in their first words are neighbours
        starts = np.concatenate(([0], np.flatnonzero(self._steps(suffixes, ranks, power, short)) + 1))
        group = np.zeros(len(text), dtype=np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        self.low, self.high = starts[group], np.append(starts[1:], len(text))[group]
        starts = np.concatenate(([0], np.flatnonzero(self._steps(suffixes, ranks, power, longest)) + 1))
        least = np.minimum.reduceat(owner[suffixes], starts)
        self.least = np.repeat(least, np.diff(np.append(starts, len(text))))

    @staticmethod
    def _steps(suffixes: np.ndarray, ranks: np.ndarray, power: int, length: int) -> np.ndarray:
        """Where neighbours in suffix order differ within ``length`` symbols."""
        differ = np.diff(ranks[suffixes]) != 0
        if length > power:
            padded = np.append(ranks, np.arange(length) + len(ranks))
            differ |= np.diff(padded[suffixes + length - power]) != 0
        return differ

    def least_owners(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """For each indexed sequence and each run of ``longest`` symbols in it, by its start,
        the least owner of a sequence that holds the run.

        Backward search from the last symbol to the first, all sequences in step. It keeps the interval of
        the longest match that starts at the symbol, up to ``longest``: before a full match is
        extended, its interval is widened to that of its first ``longest - 1`` symbols.
        """
        order = np.argsort(-lengths, kind="stable")
        starts, sizes = starts[order], lengths[order]
        runs = np.maximum(0, sizes - self.longest + 1)
        ends = np.cumsum(runs)  # a sequence's runs lie before its end in ``out``
        out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        low = np.zeros(len(sizes), dtype=np.int64)
        high = np.full(len(sizes), self.tree.size, dtype=np.int64)
        active = len(sizes)
        for step in range(int(sizes.max(initial=0))):
            while active and sizes[active - 1] <= step:
                active -= 1
            at = starts[:active] + sizes[:active] - 1 - step
            symbol = text[at]
            low, high = low[:active], high[:active]
            if step >= self.longest:
                low, high = self.low[low], self.high[low]
            ranks = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
            base = self.before[symbol]
            low, high = base + ranks[:active], base + ranks[active:]
            if step >= self.longest - 1:
                out[ends[:active] - 1 - (step - self.longest + 1)] = self.least[low]
        parts = np.split(out, ends[:-1])
        back = [out] * len(parts)
        for part, place in zip(parts, order.tolist()):
            back[place] = part
        return back

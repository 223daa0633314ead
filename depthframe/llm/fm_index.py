"""A compressed index for backward search: Burrows-Wheeler transform over a wavelet matrix, in numpy.

Symbols are small integers; 0 separates texts. All searches advance many patterns at once.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class WaveletMatrix:
    """Rank queries on a sequence of integers, one bit vector with sampled counts per binary digit."""

    def __init__(self, values: np.ndarray, largest: int):
        self.levels = max(1, int(largest).bit_length())
        n = len(values)
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.uint8)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(U64)
            self.words.append(words)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.zeros.append(n - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``; ``start`` is where its run starts after the last level."""
        for level, (words, before, zeros) in enumerate(zip(self.words, self.before, self.zeros)):
            word = at >> 6
            below = (U64(1) << (at & 63).astype(U64)) - U64(1)
            ones = before[word] + np.bitwise_count(words[word] & below)
            one = (symbol >> (self.levels - 1 - level)) & 1
            at = np.where(one, zeros + ones, at - ones)
        return at - start

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        return self.rank(symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64))


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next ``depth`` symbols (at least), by doubling."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    span = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        span *= 2
        if span >= depth or (n and new[-1] == n - 1):
            return order


class FMIndex:
    """Backward search that stays alive while the pattern occurs in a text of a smaller owner.

    ``symbols`` ends every text with 0; ``owner`` gives each position a number. Patterns of up to
    ``depth`` symbols are found exactly.
    """

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, depth: int):
        order = sorted_suffixes(symbols, depth)
        largest = int(symbols.max(initial=0))
        self.wavelet = WaveletMatrix(symbols[order - 1], largest)
        every = np.arange(largest + 1)
        self.run = self.wavelet.starts(every)
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=largest + 1))[:-1]]
        self.size = len(symbols)
        self.least = [owner[order].astype(np.int32)]
        span = 1
        while 2 * span <= self.size:
            low = self.least[-1]
            self.least.append(np.minimum(low[:-span], low[span:]))
            span *= 2
        self.flat = np.concatenate(self.least)
        self.level_at = np.r_[0, np.cumsum([len(x) for x in self.least])[:-1]]

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put in front."""
        both = self.wavelet.rank(np.tile(symbol, 2), np.concatenate([low, high]), np.tile(self.run[symbol], 2))
        both += np.tile(self.first[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest owner in each non-empty interval."""
        level = np.frexp((high - low).astype(np.float64))[1].astype(np.int64) - 1
        base = self.level_at[level]
        return np.minimum(self.flat[base + low], self.flat[base + high - (1 << level)])


def matched_windows(
    index: FMIndex, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, width: int
) -> np.ndarray:
    """Which windows of ``width`` symbols of each pattern occur in a text of a smaller owner.

    Patterns are runs of ``symbols``. Returns one flag per window, pattern after pattern. Each search
    walks left from some end; reaching the first undecided window settles all windows up to that
    end at once, and dying at a position settles all windows over the dead stretch, so matching
    patterns cost about one step a symbol and others a few steps.
    """
    count = np.maximum(0, length - width + 1)
    base = np.cumsum(count) - count
    hit = np.zeros(int(count.sum()) + 1, np.int64)  # differences, summed at the end
    lane = np.flatnonzero(count)
    at0, last, own, out = start[lane], count[lane] - 1, owner[lane], base[lane]
    s = np.zeros(len(lane), np.int64)
    wide = last.copy()  # further windows tried together with window s
    pos = s + width + wide
    low, high = np.zeros(len(lane), np.int64), np.full(len(lane), index.size)
    careful = np.zeros(len(lane), bool)
    while len(s):
        low, high = index.extend(low, high, symbols[at0 + pos - 1])
        alive = high > low
        alive[alive] = index.least_owner(low[alive], high[alive]) < own[alive]
        pos = pos - alive
        won = alive & (pos == s)
        over = ~alive | won
        if not over.any():
            continue
        np.add.at(hit, (out + s)[won], 1)
        np.add.at(hit, (out + s + wide)[won] + 1, -1)
        lost = ~alive
        alone = lost & (wide == 0)
        # a dead stretch from pos - 1 to the end kills every window that starts before pos
        s = np.where(won, s + wide + 1, np.where(alone, pos, s))
        rest = last - s
        grown = np.where(won, np.minimum(np.maximum(2 * wide, np.where(wide == 0, rest // 2, 0)), rest), 0)
        shrunk = np.where(lost & ~alone, np.where(careful, wide // 2, 0), 0)
        wide = np.where(won, np.maximum(grown, 0), np.where(lost, shrunk, wide))
        careful |= over
        pos = np.where(over, s + width + wide, pos)
        low, high = np.where(over, 0, low), np.where(over, index.size, high)
        keep = s <= last
        if not keep.all():
            at0, last, own, out, s, wide, pos, low, high, careful = (
                x[keep] for x in (at0, last, own, out, s, wide, pos, low, high, careful)
            )
    return np.cumsum(hit[:-1]) > 0

"""A compressed FM-index in numpy: a wavelet matrix over the Burrows-Wheeler transform.

Bits are packed 64 to a word with a running count for each word, so a symbol
costs about log2(alphabet) bits and half as many again. All queries take a
step at once: a backward step is two rank queries on every level.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, bool)
        self.words = np.packbits(np.concatenate([bits, pad]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class Wavelet:
    """A wavelet matrix: rank of any symbol in a prefix, in one step for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        for shift in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[k] before i[k], counted from where the symbol's run starts (see start)."""
        for shift, bits in self.levels:
            ones = bits.rank1(i)
            i = np.where(symbol >> shift & 1, bits.zeros + ones, i - ones)
        return i

    def start(self, alphabet: int) -> np.ndarray:
        """Where each symbol's run starts on the last level: rank() of an empty prefix."""
        symbol = np.arange(alphabet)
        return self.rank(symbol, np.zeros(alphabet, np.int64))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least, by prefix doubling; ties by place."""
    rank = text.astype(np.int64)
    done, n = 1, len(text)
    while done < depth:
        after = np.zeros(n, np.int64)
        after[: n - done] = rank[done:] + 1 if done < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[0] = 0
        step[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        done *= 2
        if rank[order[-1]] == n - 1:
            break
    return np.argsort(rank, kind="stable")


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The common prefix of each suffix with the one before it in order, up to `depth` symbols and never past a 0."""
    out = np.zeros(len(order), np.uint8)
    live = np.arange(1, len(order))
    for t in range(depth):
        a, b = order[live] + t, order[live - 1] + t
        inside = np.maximum(a, b) < len(text)
        live, a, b = live[inside], a[inside], b[inside]
        live = live[(text[a] == text[b]) & (text[a] != 0)]
        if not len(live):
            break
        out[live] = t + 1
    return out


class FMIndex:
    """Backward search over a text of symbols 1 .. alphabet - 1, with 0 for separators, for patterns of at most `depth` symbols."""

    def __init__(self, text: np.ndarray, alphabet: int, depth: int):
        self.size, self.depth = len(text), depth
        self.order = suffix_order(text, depth)
        transform = text[self.order - 1]  # of the first symbol: the last one, a separator
        self.wavelet = Wavelet(transform, alphabet)
        self.base = self.wavelet.start(alphabet)
        count = np.bincount(text, minlength=alphabet)
        self.first = np.concatenate([[0], np.cumsum(count)])[:-1]
        # common prefixes, with 0 at either end, and their minima over 2, 4, 8, ...
        self.common = [np.append(common_prefixes(text, self.order, depth), np.uint8(0))]
        while 1 << len(self.common) <= self.size:
            last, h = self.common[-1], 1 << (len(self.common) - 1)
            self.common.append(np.minimum(last[:-h], last[h:]))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The intervals of symbol + pattern, from the patterns' intervals."""
        shift = self.first[symbol] - self.base[symbol]
        return shift + self.wavelet.rank(symbol, low), shift + self.wavelet.rank(symbol, high)

    def widen(self, low: np.ndarray, high: np.ndarray, length: np.ndarray):
        """The intervals of the suffixes that share `length` symbols with those in [low, high)."""
        low, high = low.copy(), high.copy()
        # every prefix in common[low + 1 : high] is long enough; go on to the first short one on either side
        for k in range(len(self.common) - 1, -1, -1):
            least, h = self.common[k], 1 << k
            left = low - h + 1  # common[left : low + 1]
            ok = (left >= 0) & (least[np.maximum(left, 0)] >= length)
            low = np.where(ok, low - h, low)
            right = np.minimum(high, len(least) - 1)  # common[high : high + h]
            ok = (high + h <= self.size) & (least[right] >= length)
            high = np.where(ok, high + h, high)
        return np.maximum(low, 0), high

    def shorten(self, low: np.ndarray, high: np.ndarray):
        """The longest shorter matches whose intervals are larger, and those intervals."""
        length = np.maximum(self.common[0][low], self.common[0][high]).astype(np.int64)
        return (*self.widen(low, high, length), length)

"""A compressed FM-index of word sequences, for many queries side by side.

The sequences of a shard stand one after another, each behind its own end mark.
The index keeps their Burrows-Wheeler transform as a wavelet tree of packed bits
with counts of a word each, the places of the suffixes, and the lengths of
common prefixes up to a cap. Backward search extends matches to the left and
shortens them on the right where they do not extend; the match lengths that it
gives at each place of a query are its matching statistics.
"""

from __future__ import annotations

import numpy as np


class _Bits:
    """Packed bits with the number of ones before each 64."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros(-(-(len(flags) + 1) // 64) * 64, np.uint8)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, low = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))


class _WaveletTree:
    """Ranks of symbols, by a level of bits for each bit of a symbol, the highest first."""

    def __init__(self, symbols: np.ndarray, height: int):
        self.levels: list[tuple[_Bits, int]] = []
        for level in range(height - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            self.levels.append((_Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.height = height

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        low, high = np.zeros_like(i), i.copy()
        for level, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.height - 1 - level) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks by their first 1, 2, 4, ... symbols; end marks are distinct symbols."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    ranks, step = [rank.astype(np.int64)], 1
    while True:
        rank = ranks[-1]
        behind = np.full(n, -1, np.int64)
        behind[: max(n - step, 0)] = rank[step:]
        key = rank * (n + 1) + behind + 1
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1:
            return order, ranks
        ranks.append(rank)
        step *= 2


class FMIndex:
    """Index of sequences of word hashes; match lengths are told up to ``cap``."""

    def __init__(self, sequences: list[np.ndarray], cap: int):
        self.cap = cap
        self.words = np.unique(np.concatenate(sequences)) if sequences else np.zeros(0, np.uint64)
        ends = np.cumsum([len(s) + 1 for s in sequences])
        self.n = int(ends[-1]) if sequences else 0
        self.starts = ends - np.array([len(s) + 1 for s in sequences], np.int64) if sequences else np.zeros(0, np.int64)
        text, own = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for i, (s, e) in enumerate(zip(sequences, ends, strict=True)):
            text[e - 1 - len(s) : e - 1] = np.searchsorted(self.words, s) + 1
            own[e - 1 - len(s) : e] = i
        marked = text + len(sequences)
        marked[ends - 1] = np.arange(len(sequences))
        self.places, ranks = suffix_order(marked) if self.n else (np.zeros(0, np.int64), [])
        self.owner = own[self.places]
        before = text[self.places - 1]  # the last end mark stands before the first suffix
        self.tree = _WaveletTree(before, max(1, int(len(self.words)).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.words) + 2))])
        self._prefixes(ranks)

    def _prefixes(self, ranks: list[np.ndarray]) -> None:
        """Common prefixes of neighbours in the order, up to the cap, and their least over powers of two."""
        a, b = self.places[:-1].copy(), self.places[1:].copy()
        found = np.zeros(max(self.n - 1, 0), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            # suffixes that agree in more than a power of two symbols agree in no end mark before that
            inside = np.flatnonzero((a < self.n) & (b < self.n))
            same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
            found[same] += 1 << level
            a[same] += 1 << level
            b[same] += 1 << level
        lcp = np.zeros(self.n + 1, np.uint8 if self.cap < 256 else np.uint32)
        lcp[1 : self.n] = np.minimum(found, self.cap)
        self.lcp = lcp  # lcp[i]: of the suffixes i - 1 and i; 0 at both ends
        self.least = [lcp]
        while (1 << len(self.least)) <= self.n + 1:
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def widen(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that share ``length`` words with those of each interval."""
        low, high = low.copy(), high.copy()
        for level in range(len(self.least) - 1, -1, -1):
            row, step = self.least[level], 1 << level
            at = low - step + 1
            go = np.flatnonzero(at >= 1)
            go = go[row[at[go]] >= length[go]]
            low[go] -= step
            go = np.flatnonzero(high + step <= self.n)
            go = go[row[high[go]] >= length[go]]
            high[go] += step
        return low, high

    def symbols(self, sequence: np.ndarray) -> np.ndarray:
        """The index's symbols of word hashes; 0 for words that it does not hold."""
        at = np.searchsorted(self.words, sequence)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == sequence, at + 1, 0) if len(self.words) else np.zeros(len(sequence), np.int64)

    def matching_statistics(self, queries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query (length, low, high): the longest match, up to the cap, that begins at each place.

        ``low`` and ``high`` bound the suffixes that begin with the match.
        """
        lens = np.array([len(q) for q in queries], np.int64)
        order = np.argsort(-lens, kind="stable")
        most = int(lens.max(initial=0))
        symbols = np.zeros((most, len(queries)), np.int64)  # right-aligned columns, the longest first
        for column, i in enumerate(order):
            symbols[most - lens[i] :, column] = self.symbols(queries[i])
        length = np.zeros((most, len(queries)), np.int64)
        lows, highs = np.zeros_like(length), np.full_like(length, self.n)
        n, low, high = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), np.full(len(queries), self.n, np.int64)
        sorted_lens = lens[order]
        for row in range(most - 1, -1, -1):
            live = int(np.searchsorted(-sorted_lens, -(most - row), side="right"))
            lane = np.arange(live)
            while len(lane):
                c = symbols[row, lane]
                known = c > 0
                unknown = lane[~known]
                n[unknown], low[unknown], high[unknown] = 0, 0, self.n
                lane, c = lane[known], c[known]
                both = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[lane], high[lane]]))
                a, b = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
                done = a < b
                hit = lane[done]
                low[hit], high[hit], n[hit] = a[done], b[done], n[hit] + 1
                lane = lane[~done]
                # a match that does not extend gives way to its longest prefix with more occurrences
                parent = np.maximum(self.lcp[low[lane]], self.lcp[high[lane]]).astype(np.int64)
                empty = n[lane] == 0
                parent[empty] = 0
                rest = lane[empty]
                low[rest], high[rest] = 0, self.n
                lane, parent = lane[~empty], parent[~empty]
                n[lane] = parent
                low[lane], high[lane] = self.widen(low[lane], high[lane], parent)
            over = np.flatnonzero(n[:live] > self.cap)
            if len(over):
                n[over] = self.cap
                low[over], high[over] = self.widen(low[over], high[over], n[over])
            length[row, :live], lows[row, :live], highs[row, :live] = n[:live], low[:live], high[:live]
        out: list = [None] * len(queries)
        for column, i in enumerate(order):
            at = most - lens[i]
            out[i] = (length[at:, column], lows[at:, column], highs[at:, column])
        return out

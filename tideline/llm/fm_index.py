"""A compressed full-text index over symbol sequences, and matching statistics by backward search.

The index holds the Burrows-Wheeler transform of its texts in a wavelet tree that is shaped by
the symbols' frequencies: a symbol that makes up a share p of the text has a code of
ceil(-log2 p) bits, so the tree takes at most one bit a symbol more than the text's zero-order
entropy. Ranks take a 16-bit count for each 64-bit word and a wide one for each 1,024 words. Beside it stand the common prefixes of
neighbouring rows (a byte each) for the way to the parent interval, and the owners in row order under
a table of minima.

All searches run over many patterns at once; a search step is a rank in each level of the tree.
"""

from __future__ import annotations

import numpy as np

WORDS_PER_BLOCK = 1024


class Bits:
    """A bit vector with ranks, packed into 64-bit words."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]
        self.wide = before[::WORDS_PER_BLOCK].copy()
        self.narrow = (before - np.repeat(self.wide, WORDS_PER_BLOCK)[: len(before)]).astype(np.uint16)

    def ones_before(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.wide[w // WORDS_PER_BLOCK] + self.narrow[w] + np.bitwise_count(self.words[w] & mask)


class WaveletTree:
    """Ranks in a sequence of symbols, level by level of their codes.

    Codes are canonical: shorter ones come first, so at each depth the inner nodes are a run of prefixes.
    """

    def __init__(self, values: np.ndarray, sigma: int):
        count = np.bincount(values, minlength=sigma)
        share = np.maximum(count, 1) / max(len(values) + (count == 0).sum(), 1)
        self.length = np.maximum(np.ceil(-np.log2(share)).astype(np.int64), 1)
        by_length = np.argsort(self.length, kind="stable")
        depth = int(self.length.max())
        step = np.left_shift(np.int64(1), depth - self.length[by_length])
        code = np.empty(sigma, np.int64)
        code[by_length] = np.cumsum(step) - step  # left-aligned to the full depth
        self.code, self.depth = code, depth
        self.levels: list[tuple[Bits, int, np.ndarray]] = []
        v, of = code[values], self.length[values]
        for level in range(depth):
            inner = of > level
            v, of = v[inner], of[inner]
            if not len(v):
                break
            prefix = v >> (depth - level)
            order = np.argsort(prefix, kind="stable")
            v, of, prefix = v[order], of[order], prefix[order]
            low, high = int(prefix[0]), int(prefix[-1])
            starts = np.searchsorted(prefix, np.arange(low, high + 2))
            self.levels.append((Bits(((v >> (depth - level - 1)) & 1).astype(np.uint8)), low, starts))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c stands before position i; c must occur in the sequence."""
        i = i.copy()
        live = np.arange(len(c))
        for level, (bits, low, starts) in enumerate(self.levels):
            live = live[self.length[c[live]] > level]
            if not len(live):
                break
            code, at = self.code[c[live]], i[live]
            start = starts[(code >> (self.depth - level)) - low]
            ones = bits.ones_before(start + at) - bits.ones_before(start)
            i[live] = np.where((code >> (self.depth - level - 1)) & 1 == 1, ones, at - ones)
        return i


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The order of all suffixes by their first ``depth`` symbols at least, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    size = 1
    while size < depth and rank.max() < n - 1:
        behind = np.zeros(n, np.int64)
        behind[: n - size] = rank[size:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1]
        size *= 2
    return np.argsort(rank, kind="stable")


class Minima:
    """Minima over any range of an array, from tables over ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        size = 1
        while size * 2 <= len(values):
            t = self.tables[-1]
            self.tables.append(np.minimum(t[:-size], t[size:]))
            size *= 2

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The minimum of values[lo:hi]; ranges are not empty."""
        out = np.empty(len(lo), self.tables[0].dtype)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for x in np.unique(level):
            own = level == x
            t = self.tables[x]
            out[own] = np.minimum(t[lo[own]], t[hi[own] - (1 << int(x))])
        return out


class FMIndex:
    """Texts of symbols 1 .. sigma - 1 with a 0 behind each; every text has an owner.

    Suffixes are ordered to the end of their text, at least to the longest text's length.
    """

    def __init__(self, text: np.ndarray, sigma: int, owner: np.ndarray, longest: int):
        """owner: per symbol of ``text``; longest: of all texts, in symbols, the 0 included."""
        order = suffix_order(text, longest)
        self.n, self.sigma = len(text), sigma
        self.tree = WaveletTree(text[order - 1], sigma)
        self.count = np.bincount(text, minlength=sigma)
        self.first = np.cumsum(self.count) - self.count
        self.owners, place = np.unique(owner, return_inverse=True)
        self.earliest = Minima(place[order].astype(np.int32))
        self.shared = self._shared_prefixes(text, order, longest)
        self.floors = [self.shared]  # minima over aligned runs of 2, 4, 8, .. rows
        while len(self.floors[-1]) > 1:
            f = self.floors[-1]
            f = np.r_[f, f[-1:]] if len(f) % 2 else f
            self.floors.append(np.minimum(f[::2], f[1::2]))

    @staticmethod
    def _shared_prefixes(text: np.ndarray, order: np.ndarray, longest: int) -> np.ndarray:
        """For rows 0 .. n, how many symbols a row shares with the one before it, up to the end of a text; 0 for the rows 0 and n."""
        if longest > 65535:
            raise ValueError("an indexed text has more than 65,535 symbols")
        out = np.zeros(len(text) + 1, np.uint8 if longest < 256 else np.uint16)
        live = np.arange(1, len(text))
        d = 0
        while len(live):
            a, b = order[live] + d, order[live - 1] + d
            inside = (a < len(text)) & (b < len(text))
            live, a, b = live[inside], a[inside], b[inside]
            live = live[(text[a] == text[b]) & (text[a] != 0)]
            d += 1
            out[live] = d
        return out

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of suffixes c + s for the suffixes s of the rows lo .. hi; an empty range for symbols that don't occur."""
        known = (c > 0) & (c < self.sigma)
        known &= self.count[np.where(known, c, 0)] > 0
        lo2, hi2 = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        k = c[known]
        if len(k):
            both = self.tree.rank(np.r_[k, k], np.r_[lo[known], hi[known]])
            lo2[known], hi2[known] = self.first[k] + both[: len(k)], self.first[k] + both[len(k) :]
        return lo2, hi2

    def _edge(self, row: np.ndarray, depth: np.ndarray, forward: bool) -> np.ndarray:
        """From ``row`` on, the next (or from it back, the last) row which shares fewer than ``depth`` symbols with the one before it."""
        row, level = row.copy(), np.zeros(len(row), np.int64)
        ahead = 1 if forward else -1
        # up while whole runs share enough, then down into the first run that doesn't
        live, up = np.arange(len(row)), np.ones(len(row), bool)
        while len(live):
            done = np.zeros(len(row), bool)
            for x in np.unique(level[live]):
                at = live[level[live] == x]
                low = self.floors[x][row[at]] < depth[at]
                hit, on = at[low], at[~low]
                up[hit] = False
                if x == 0:
                    done[hit] = True
                else:  # down, to the half that comes first
                    level[hit] -= 1
                    row[hit] = np.minimum(row[hit] * 2 + (0 if forward else 1), len(self.floors[x - 1]) - 1)
                moved = row[on] + ahead
                rise = up[on] & (moved % 2 == (0 if forward else 1)) & (x + 1 < len(self.floors))
                row[on] = np.where(rise, moved // 2, moved)
                level[on] += rise
            live = live[~done[live]]
        return row

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger interval whose rows share a prefix, and that prefix's length."""
        depth = np.maximum(self.shared[lo], self.shared[hi]).astype(np.int64)
        low, high = np.zeros(len(lo), np.int64), np.full(len(hi), self.n)
        some = depth > 0  # rows that share nothing meet in the whole index
        low[some], high[some] = self._edge(lo[some], depth[some], False), self._edge(hi[some], depth[some], True)
        return low, high, depth


def matches(index: FMIndex, pattern: np.ndarray, first: np.ndarray, size: np.ndarray, limit: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches (number, begin, length) of the patterns pattern[first:first+size] that occur in an indexed text
    whose owner comes before the pattern's ``limit``; all of at least ``least`` symbols that can't be extended.

    Matching statistics, from each pattern's end to its begin: the match is extended by the symbol
    before it as long as an earlier owner's text goes on like that. Where none does, the match is reported if it is long
    enough, and drops symbols at its end by stepping to the parent interval until the extension
    works or nothing is left of it. A pattern is done when no match that is long enough fits in front.
    """
    bound = np.searchsorted(index.owners, limit)  # owners before the limit have smaller places
    lane = np.flatnonzero((size >= least) & (bound > 0))
    at = (first + size)[lane]  # the match is pattern[at:end]
    end = at.copy()
    lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), index.n)
    found = []
    while len(lane):
        more = at > first[lane]
        lo2, hi2 = index.step(np.where(more, pattern[np.maximum(at - 1, 0)], 0), lo, hi)
        ok = lo2 < hi2
        ok[ok] = index.earliest.over(lo2[ok], hi2[ok]) < bound[lane[ok]]
        stuck = np.flatnonzero(~ok)
        long_ = stuck[end[stuck] - at[stuck] >= least]
        found.append((lane[long_], at[long_], end[long_] - at[long_]))
        lo[ok], hi[ok], at[ok] = lo2[ok], hi2[ok], at[ok] - 1
        # a match of nothing leaves the symbol out; any other steps to its parent
        none = stuck[end[stuck] == at[stuck]]
        at[none] -= 1
        end[none] = at[none]
        some = stuck[end[stuck] > at[stuck]]
        if len(some):
            lo[some], hi[some], depth = index.parent(lo[some], hi[some])
            end[some] = at[some] + np.minimum(depth, end[some] - at[some] - 1)
        go = (at > first[lane]) & (end - first[lane] >= least) | ((at == first[lane]) & ok)
        lane, at, end, lo, hi = lane[go], at[go], end[go], lo[go], hi[go]
    number, begin, length = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return number, begin - first[number], length

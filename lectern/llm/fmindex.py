"""An FM-index over words in numpy: wavelet matrix, backward search, truncated matching statistics.

Suffixes are ordered by their first ``depth`` symbols (prefix doubling), which is enough to search
patterns of at most ``depth`` symbols backwards. The Burrows-Wheeler transform is kept as a wavelet
matrix of packed bits, about log2(alphabet) bits a symbol, with a counter for each 64-bit word.
Many patterns are searched at once; every step is a few array operations for all of them.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        room = np.zeros((n // 64 + 1) * 8, np.uint8)
        room[: len(packed)] = packed
        self.words = room.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class Wavelet:
    """Wavelet matrix of integers below 2**levels."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.planes, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bits = (values >> level & 1).astype(bool)
            self.planes.append(Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            values = np.concatenate((values[~bits], values[bits]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        lo = np.zeros_like(at)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = (symbol >> level & 1).astype(bool)
            both = self.planes[k].rank(np.concatenate((lo, at)))
            a, b = both[: len(at)], both[len(at) :]
            lo, at = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, at - b)
        return at - lo


class FMIndex:
    """Index of pieces of symbols (0 <= symbol); ``owner`` gives each piece's document.

    ``least`` holds, for each distinct run of ``depth`` symbols, the smallest owner among its occurrences."""

    def __init__(self, pieces: list[np.ndarray], owner: np.ndarray, depth: int):
        self.depth = depth
        sizes = np.array([len(p) + 1 for p in pieces])
        n = int(sizes.sum())
        text = np.zeros(n, np.int64)
        ends = np.cumsum(sizes)
        for p, e in zip(pieces, ends, strict=True):
            text[e - 1 - len(p) : e - 1] = p + 1  # 0 ends a piece
        owners = np.repeat(owner, sizes)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.alphabet, symbols = np.unique(text, return_inverse=True)
        h = 1
        shift = lambda r, k: np.concatenate((r[k:], np.zeros(min(k, n), np.int64)))[:n]
        while h < depth:
            k = min(h, depth - h)  # the last step overlaps, so that ranks are by depth symbols exactly
            rank = np.unique(rank * (int(rank.max()) + 2) + shift(rank + 1, k), return_inverse=True)[1].astype(np.int64)
            h += k
        order = np.argsort(rank, kind="stable")
        self.n = n
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols))))
        self.wavelet = Wavelet(symbols[order - 1], max(1, int(len(self.alphabet) - 1).bit_length()))
        sorted_rank = rank[order]
        self.starts = np.flatnonzero(np.diff(sorted_rank, prepend=-1))
        self.group = sorted_rank.astype(np.int32)
        self.least = np.minimum.reduceat(owners[order], self.starts)
        self.ends = np.concatenate((self.starts[1:], [n]))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step of intervals [lo, hi); empty where the symbol doesn't precede."""
        at = np.searchsorted(self.alphabet, symbol + 1)
        known = (at < len(self.alphabet)) & (self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == symbol + 1)
        at = np.where(known, at, 0)
        r = self.wavelet.rank(np.concatenate((at, at)), np.concatenate((lo, hi)))
        lo, hi = self.first[at] + r[: len(lo)], self.first[at] + r[len(lo) :]
        return np.where(known, lo, 0), np.where(known, hi, 0)

    def _search(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of text[a:b) of each lane, from scratch."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.n)
        at = b.copy()
        while (go := np.flatnonzero((at > a) & (lo < hi))).size:
            at[go] -= 1
            lo[go], hi[go] = self.step(text[at[go]], lo[go], hi[go])
        return lo, hi

    def matching_statistics(self, streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of the concatenated streams: the length of the longest match with the index
        that starts there, cut at ``depth`` and at the stream's end; and, where it is ``depth``, the
        smallest owner of that run (else -1). The third array holds the streams' starts.

        Each stream is read from its end. A match grows to the left by a backward step; when it is
        ``depth`` long its interval is widened to the whole group of that run, which drops the last
        symbol. When a step fails, the longest prefix that still matches is found by bisection."""
        sizes = np.array([len(s) for s in streams], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        text = np.concatenate(streams) if len(streams) else np.empty(0, np.int64)
        length, least = np.zeros(len(text), np.int64), np.full(len(text), -1, np.int64)
        if not len(text):
            return length, least, begin
        lanes = np.argsort(-sizes, kind="stable")
        lo, hi, ell = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.n), np.zeros(len(lanes), np.int64)
        order = -sizes[lanes]
        for back in range(1, int(sizes.max()) + 1):
            live = int(np.searchsorted(order, -back, side="right"))
            at = begin[lanes[:live] + 1] - back
            a, b = self.step(text[at], lo[:live], hi[:live])
            grown = ell[:live] + 1
            if (bad := np.flatnonzero(a >= b)).size:
                good, fail = np.zeros(len(bad), np.int64), grown[bad]  # of these lengths: matches, doesn't
                a[bad], b[bad] = 0, self.n
                while (go := np.flatnonzero(fail - good > 1)).size:
                    mid = (good[go] + fail[go]) // 2
                    x, y = self._search(text, at[bad[go]], at[bad[go]] + mid)
                    ok = x < y
                    good[go], fail[go] = np.where(ok, mid, good[go]), np.where(ok, fail[go], mid)
                    a[bad[go[ok]]], b[bad[go[ok]]] = x[ok], y[ok]
                grown[bad] = good
            full = np.flatnonzero(grown >= self.depth)
            if full.size:
                g = self.group[a[full]]
                a[full], b[full], grown[full] = self.starts[g], self.ends[g], self.depth
                least[at[full]] = self.least[g]
            # an interval of depth symbols stands for the run; one symbol less is kept for the next step
            lo[:live], hi[:live], ell[:live] = a, b, grown
            length[at] = grown
        return length, least, begin

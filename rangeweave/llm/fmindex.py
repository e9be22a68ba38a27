"""A compressed FM-index over integer symbols: numpy only, no Spark."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector packed to 64-bit words with a running count for each word: 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each i."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class Wavelet:
    """Wavelet tree, levels stored one after another (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for k in reversed(range(self.depth)):
            bit = (symbols >> k) & 1
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each i."""
        lo, hi = np.zeros(len(i), dtype=np.int64), i.astype(np.int64)
        for k, (bits, zeros) in zip(reversed(range(self.depth)), self.levels, strict=True):
            one = ((symbol >> k) & 1).astype(bool)
            a, b = bits.ones(lo), bits.ones(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Index of texts laid end to end, each closed by symbol 0; symbols from 1.

    Suffixes are ordered by their first 2**rounds symbols, which is as much as a pattern of at most
    that length needs. `width`: the pattern length for which matching statistics are wanted; classes of
    suffixes that agree on width - 1 symbols let a search drop the last symbol of its pattern.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, width: int):
        """owner: of each position of text, a number; windows() returns the smallest of a match's."""
        n, depth = len(text), max(1, int(width - 1).bit_length())
        rank = text.astype(np.int64)
        half = rank
        for k in range(depth):
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - (1 << k))] = rank[1 << k :] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            moved = np.empty(n, dtype=np.int64)
            moved[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if n else []
            half, rank = rank, moved
            size = 1 << k  # half orders by so many symbols
        self.width, self.n = width, n
        self.sigma = int(text.max()) + 1 if n else 1
        self.tree = Wavelet(text[order - 1], self.sigma)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])

        def edges(length: int) -> np.ndarray:
            """Where, in suffix order, the first `length` symbols change; size < length <= 2 * size."""
            tail = np.zeros(n, dtype=np.int64)
            tail[: max(0, n - (length - size))] = half[length - size :] + 1
            a, b = half[order], tail[order]
            return np.concatenate([[0], np.nonzero((np.diff(a) != 0) | (np.diff(b) != 0))[0] + 1])

        self.shorter = np.concatenate([edges(width - 1), [n]])
        self.exact = edges(width)
        self.least = np.minimum.reduceat(owner[order], self.exact) if n else owner

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many patterns at once."""
        base = self.start[symbol]
        return base + self.tree.rank(symbol, lo), base + self.tree.rank(symbol, hi)

    def windows(self, texts: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Matching statistics, cut at width, of streamed texts that are among the indexed ones: at each
        position that begins `width` symbols of its text, the least owner of a match; else -1.

        texts: symbols end to end; begin, length: of each text.
        """
        out = np.full(len(texts), -1, dtype=np.int64)
        lo, hi = np.zeros(len(begin), dtype=np.int64), np.full(len(begin), self.n, dtype=np.int64)
        matched = np.zeros(len(begin), dtype=np.int64)
        for step in range(1, int(length.max(initial=0)) + 1):
            live = np.nonzero(length >= step)[0]
            at = begin[live] + length[live] - step
            a, b = self.extend(texts[at], lo[live], hi[live])
            m = matched[live] + 1
            if (a >= b).any():
                raise ValueError("a text is not in the index")
            full = m == self.width
            if full.any():
                out[at[full]] = self.least[np.searchsorted(self.exact, a[full], side="right") - 1]
                k = np.searchsorted(self.shorter, a[full], side="right")
                a[full], b[full], m[full] = self.shorter[k - 1], self.shorter[k], self.width - 1
            lo[live], hi[live], matched[live] = a, b, m
        return out

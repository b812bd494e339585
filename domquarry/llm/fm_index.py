"""An FM-index over a sequence of small integers, in arrays: wavelet-matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks and access of a sequence over an alphabet of ``sigma`` symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.rows: list[tuple[Bits, int]] = []
        s = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            self.rows.append((Bits(bit), int(len(s) - bit.sum())))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols, element by element."""
        a, b = np.zeros_like(i), i
        for k, (bits, zeros) in enumerate(self.rows):
            one = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            ra, rb = bits.rank1(a), bits.rank1(b)
            a, b = np.where(one, zeros + ra, a - ra), np.where(one, zeros + rb, b - rb)
        return b - a

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for bits, zeros in self.rows:
            one = bits.get(i).astype(np.int64)
            r = bits.rank1(i)
            i = np.where(one == 1, zeros + r, i - r)
            c = 2 * c + one
        return c


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling on arrays; s ends with a symbol 0 that is the least and stands nowhere else."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    """symbols: integers from 1 up to below sigma. A final 0 is added."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 8):
        s = np.append(np.asarray(symbols, np.int64), 0)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.n, self.sample = len(s), sample
        self.starts = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=sigma), out=self.starts[1:])
        self.wavelet = WaveletMatrix(bwt, sigma)
        kept = sa % sample == 0
        self.marked, self.positions = Bits(kept), sa[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of equal length: ranges of suffixes that begin with each."""
        m, length = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in range(length - 1, -1, -1):
            c = patterns[live, j].astype(np.int64)
            lo[live] = self.starts[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.starts[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which range, position in the text) of all suffixes in the ranges: steps back until a sampled one."""
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which]
        found, steps, live = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        while len(live):
            i = at[live]
            done = self.marked.get(i).astype(bool)
            found[live[done]] = self.positions[self.marked.rank1(i[done])] + steps
            live, i = live[~done], i[~done]
            c = self.wavelet.access(i)
            at[live] = self.starts[c] + self.wavelet.rank(c, i)
            steps += 1
        return which, found

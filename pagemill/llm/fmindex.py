"""An FM-index over word numbers: a wavelet matrix of the Burrows-Wheeler transform, searched backward for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(c, i): how often c occurs before i. One packed bit vector a level, with the ones before each 64-bit block."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.blocks: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        v = values
        for level in range(self.levels - 1, -1, -1):
            bit = (v >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.blocks.append(packed)
            self.before.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1].astype(np.int32))
            self.zeros.append(int(len(bit) - np.count_nonzero(bit)))
            v = np.concatenate([v[~bit], v[bit]])
        self.base = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][block] + np.bitwise_count(self.blocks[k][block] & mask)
            i = np.where(c >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(c, i) - self.base[c]


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols at least; enough for patterns of that length, whose intervals do not
    depend on how longer ties are ordered."""
    n = len(text)
    key = text.astype(np.int64) << 32
    key[:-1] |= text[1:]
    known = 2
    while True:
        order = np.argsort(key, kind="stable")
        if known >= depth:
            return order
        s = key[order]
        new = np.ones(n, np.int64)
        new[1:] = s[1:] != s[:-1]
        place = np.empty(n, np.int64)
        place[order] = np.cumsum(new)
        key = place << 32
        key[: n - known] |= place[known:]
        known *= 2


class FMIndex:
    """Of texts one after another, symbols from 1 on, each text closed by 0.

    The suffix array goes once the transform is made; what stays of it is the owner of each suffix's text, in 32 bits. (Samples of the array, and steps from row
    to row between them, would need suffixes sorted to their ends; these are sorted as deep as patterns are long.)
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int, owners: np.ndarray):
        suffixes = sorted_suffixes(text, depth)
        self.size = len(text)
        self.owners = owners[suffixes].astype(np.int32)
        self.bwt = WaveletMatrix(text[suffixes - 1], sigma)
        del suffixes
        self.starts = np.append(0, np.cumsum(np.bincount(text, minlength=sigma)))[:sigma]

    def search(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the `length` symbols that end before each of `ends` in a text that is indexed itself: for each, the
        symbols matched by two places or more (their matching statistic, up to `length`), and the last interval of suffixes.
        A pattern leaves the search when it is found in one place only."""
        n = len(ends)
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        matched = np.zeros(n, np.int64)
        live = np.arange(n)
        for step in range(1, length + 1):
            c = text[ends[live] - step]
            l = self.starts[c] + self.bwt.rank(c, low[live])  # noqa: E741
            h = self.starts[c] + self.bwt.rank(c, high[live])
            more = h - l >= 2
            live = live[more]
            low[live], high[live] = l[more], h[more]
            matched[live] = step
            if not len(live):
                break
        return matched, low, high

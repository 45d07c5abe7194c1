"""Elias-Fano sequences over NumPy arrays, which may be memory-mapped: access and successor search for many at once."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
#: For each byte, the place of its k-th set bit (8 where it has fewer), at 8 * byte + k.
_SELECT = np.full((256, 8), 8, np.uint64)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_at)] = _at
_SELECT = _SELECT.ravel()
_EACH = 0x0101010101010101  # a one in each byte of a word
_PAIRS, _FOURS, _BYTES, _TOPS, _LOWS = (np.uint64(x * _EACH) for x in (0x55, 0x33, 0x0F, 0x80, 1))
_1, _2, _3, _4, _8, _FF = (np.uint64(x) for x in (1, 2, 3, 4, 8, 0xFF))


def _in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 0) in each 64-bit word, which has more than k."""
    k = k.astype(np.uint64)
    x = words - ((words >> _1) & _PAIRS)
    x = (x & _FOURS) + ((x >> _2) & _FOURS)
    sums = ((x + (x >> _4)) & _BYTES) * _LOWS  # in each byte: the set bits up to its end
    at = np.bitwise_count(((k * _LOWS | _TOPS) - sums) & _TOPS).astype(np.uint64) << _3  # where the bit's byte begins
    before = ((sums << _8) >> at) & _FF
    return (at + _SELECT[((((words >> at) & _FF) << _3) + k - before).astype(np.int64)]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of n unsigned integers: the low bits packed, the high ones in unary.

    ``parts`` are the arrays it consists of: sizes, packed low bits, unary high bits, ones before each word of them.
    """

    def __init__(self, parts: list[np.ndarray]):
        sizes, self.low, self.high, self.ones = parts
        self.n, self.bits = int(sizes[0]), int(sizes[1])
        self.mask = np.uint64((1 << self.bits) - 1)
        self._zeros = None

    @staticmethod
    def build(values: np.ndarray) -> list[np.ndarray]:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            v = values & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(low, word, v << shift)
            over = (shift + np.uint64(bits)) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((int(place[-1]) + 2 if n else 1) + 63) // 64 * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view("<u8").astype(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return [np.array([n, bits], np.uint64), low, high, ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # a shift by 64 is avoided by two shifts
        return ((self.low[word] >> shift) | ((self.low[word + 1] << (np.uint64(63) - shift)) << ONE)) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        return self._value(i, word * 64 + _in_word(self.high[word], i - self.ones[word]))

    def _value(self, i: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def ranges(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places ``i`` and those at the places after them, which there must be."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        bit = _in_word(self.high[word], i - self.ones[word])
        later = (self.high[word] >> bit.astype(np.uint64)) >> ONE
        # the next one, most often in the same word
        after = self._value(i + 1, word * 64 + bit + 1 + np.bitwise_count((later & (~later + ONE)) - ONE))
        far = np.flatnonzero(later == 0)
        after[far] = self[i[far] + 1]
        return self._value(i, word * 64 + bit), after

    def _around(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values have a high part below ``high``, and how many one of at most ``high``."""
        if self._zeros is None:
            self._zeros = np.arange(len(self.ones)) * 64 - self.ones
        zeros = self._zeros[-1]
        out, upto = np.zeros(len(high), np.int64), np.full(len(high), self.n)
        out[high > zeros] = self.n
        k = high - 1  # the zero that ends the bucket before
        inner = np.flatnonzero((k >= 0) & (k < zeros))
        k = k[inner]
        word = np.searchsorted(self._zeros, k, side="right") - 1
        bit = _in_word(~self.high[word], k - self._zeros[word])
        out[inner] = word * 64 + bit - k
        # the next zero, most often in the same word, ends the bucket
        later = (~self.high[word] >> bit.astype(np.uint64)) >> ONE
        near = np.flatnonzero(later)
        first = later[near]
        upto[inner[near]] = out[inner[near]] + np.bitwise_count((first & (~first + ONE)) - ONE)
        rest = np.concatenate([np.flatnonzero(high == 0), inner[later == 0]])
        k = high[rest]
        rest, k = rest[k < zeros], k[k < zeros]
        word = np.searchsorted(self._zeros, k, side="right") - 1
        upto[rest] = word * 64 + _in_word(~self.high[word], k - self._zeros[word]) - k
        return out, upto

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi) whose value is at least ``x``, else hi; values below lo are below x."""
        return self._search(x, lo, hi)[0]

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi) whose value is ``x``, else -1; values below lo are below x."""
        a, end, want = self._search(x, lo, hi)
        hit = np.flatnonzero(a < end)  # those whose high part is x's
        hit = hit[self._low(a[hit]) == want[hit]]
        out = np.full(len(a), -1, np.int64)
        out[hit] = a[hit]
        return out

    def _search(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Successors of ``x``, where the values with its high part end, and its low part."""
        x = np.asarray(x, np.uint64)
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        a, b = (np.minimum(np.maximum(x, lo), hi) for x in self._around(high))
        end = b.copy()
        want = x & self.mask
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            small = self._low(mid) < want[live]
            a[live[small]] = mid[small] + 1
            b[live[~small]] = mid[~small]
            live = live[a[live] < b[live]]
        return a, end, want

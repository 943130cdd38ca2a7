"""Sorted numbers in Elias-Fano form, and a two-level n-gram trie made of them.

Every number's low bits stand in a packed row; its high part is the number of zeros before its
one in a bit vector, whose counts of ones before each 64-bit word make single numbers and
successors cheap to find. All look-ups work on arrays of queries at once.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

U8 = np.uint64
#: Place of the j-th one of each byte.
_ONES = np.zeros((256, 8), U8)
for _byte in range(256):
    for _j, _at in enumerate(k for k in range(8) if _byte >> k & 1):
        _ONES[_byte, _j] = _at
_M1, _M2, _M4, _EACH, _TOP = (U8(int(f"{byte:02x}" * 8, 16)) for byte in (0x55, 0x33, 0x0F, 0x01, 0x80))
#: So many numbers are worked on at once when they are packed.
SLICE = 1 << 18
#: Log10 values are kept in steps of this size, in 16 bits.
STEP = 1 / 2048


def quantised(log10: np.ndarray) -> np.ndarray:
    """Codes of values up to 0, in steps of STEP."""
    return np.minimum(np.rint(-log10 / STEP), 65535).astype(np.uint16)


def value_of(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * -STEP


class EliasFano:
    """``n`` non-decreasing numbers; ``arrays`` are all that is kept of them."""

    def __init__(self, n: int, bits: int, arrays: list[np.ndarray]):
        self.n, self.bits, self.arrays = n, bits, arrays
        self.low, self.high, self.ranks = arrays
        self.mask = U8((1 << bits) - 1)
        self.blanks = 64 * np.arange(len(self.ranks), dtype=np.int64) - self.ranks.astype(np.int64)
        self.top = (int(self.select(np.array([n - 1]))[0]) - (n - 1)) if n else -1

    @classmethod
    def of(cls, x: np.ndarray) -> EliasFano:
        x, n = x.astype(U8), len(x)
        bits = max(0, (int(x[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros(n * bits // 64 + 2, U8)
        high = np.zeros(((int(x[-1]) >> bits) + n if n else 0) // 64 + 2, U8)
        for lo in range(0, n, SLICE):
            some = x[lo : lo + SLICE]
            each = np.arange(lo, lo + len(some), dtype=np.int64)
            if bits:
                at = each * bits
                part, shift = some & U8((1 << bits) - 1), (at & 63).astype(U8)
                np.bitwise_or.at(low, at >> 6, part << shift)
                over = (at & 63) + bits > 64
                np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (U8(64) - shift[over]))
            place = (some >> U8(bits)).astype(np.int64) + each
            np.bitwise_or.at(high, place >> 6, U8(1) << (place & 63).astype(U8))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32 if n < 1 << 31 else np.int64)
        return cls(n, bits, [low, high, ranks])

    def _in_word(self, words: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Place of the nth one of each word: ones up to each byte by adding within the word, then a table for the byte."""
        ones = words - (words >> U8(1) & _M1)
        ones = (ones & _M2) + (ones >> U8(2) & _M2)
        upto = ((ones + (ones >> U8(4))) & _M4) * _EACH
        want = nth.astype(U8)
        passed = np.bitwise_count(((want * _EACH | _TOP) - upto) & _TOP).astype(U8) << U8(3)  # bits of the bytes before
        before = (upto << U8(8)) >> passed & U8(255)
        return (passed + _ONES[words >> passed & U8(255), want - before]).astype(np.int64)

    def select(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th one."""
        word = np.searchsorted(self.ranks, i, "right") - 1
        return 64 * word + self._in_word(self.high[word], i - self.ranks[word].astype(np.int64))

    def _select_blank(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.blanks, i, "right") - 1
        return 64 * word + self._in_word(~self.high[word], i - self.blanks[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U8)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(U8)
        upper = np.where(shift > 0, self.low[word + 1] << ((U8(64) - shift) & U8(63)), U8(0))
        return (self.low[word] >> shift | upper) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.select(i) - i).astype(U8) << U8(self.bits) | self._low(i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a smaller high part."""
        known = np.clip(high - 1, 0, max(self.top, 0))
        count = self._select_blank(known) - known if self.n else np.zeros(len(high), np.int64)
        return np.where(high <= 0, 0, np.where(high > self.top, self.n, count))

    def find(self, x: np.ndarray, start: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """Index of each number within its range from ``start`` to ``end``, -1 where it isn't there.

        Its successor there is looked for: by the high part, then by halving among equal ones.
        """
        x = x.astype(U8)
        high, want = (x >> U8(self.bits)).astype(np.int64), x & self.mask
        lo = np.maximum(self._below(high), start)
        stop = np.minimum(self._below(high + 1), self.n if end is None else end)
        hi = np.maximum(stop, lo)
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) // 2
            less = self._low(middle) < want[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
        hit = np.flatnonzero(lo < stop)
        found = np.full(len(x), -1, np.int64)
        same = hit[self._low(lo[hit]) == want[hit]]
        found[same] = lo[same]
        return found


class Trie:
    """Words with their successors, and the probabilities of both, in a memory-mapped file.

    First level: the words' hashes, and for each its count, the code of its own probability, that of
    the share it leaves as a context to unseen successors (65535: it is no context), and a
    pointer to its successors. Second level: the successors' numbers, relative to their context:
    each context's numbers begin where those of the one before ended, so that the whole row is
    monotone. With them go the codes of their probabilities. The file has no name and goes with
    the process.
    """

    NO_CONTEXT = 65535

    def __init__(self, words: np.ndarray, count: np.ndarray, own: np.ndarray, left: np.ndarray, context: np.ndarray, successor: np.ndarray, follow: np.ndarray):
        """``words`` ascending; (``context``, ``successor``) are numbers of words, ascending; ``own``, ``left`` and ``follow`` are codes."""
        pointers = np.searchsorted(context, np.arange(len(words) + 1))
        last = np.zeros(len(words) + 1, np.int64)  # what a context's numbers are counted from
        ends = np.flatnonzero(np.diff(pointers) > 0)
        last[ends + 1] = successor[pointers[ends + 1] - 1]
        levels = [EliasFano.of(words), EliasFano.of(pointers), EliasFano.of(successor + np.cumsum(last)[context])]
        plain = [np.asarray(count, np.int64), own, left, follow]
        arrays = [a for e in levels for a in e.arrays] + plain
        with tempfile.TemporaryFile() as file:
            places = []
            for a in arrays:
                file.write(b"\0" * (-file.tell() % 8))
                places.append(file.tell())
                file.write(a.tobytes())
            file.write(b"\0")
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.bytes = len(self.map)
        held = [np.frombuffer(self.map, a.dtype, len(a), at) for a, at in zip(arrays, places, strict=True)]
        self.words, self.pointers, self.successors = (EliasFano(e.n, e.bits, held[3 * i : 3 * i + 3]) for i, e in enumerate(levels))
        self.count, self.own, self.left, self.follow = held[9:]

    def look_up(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of each pair of word numbers among the successors, -1 where it is unseen; -1 is an unknown word."""
        found = np.full(len(word), -1, np.int64)
        known = np.flatnonzero((context >= 0) & (word >= 0))
        if not known.size or not self.successors.n:
            return found
        contexts, which = np.unique(context[known], return_inverse=True)
        start, end = self.pointers[contexts].astype(np.int64), self.pointers[contexts + 1].astype(np.int64)
        base = np.where(start > 0, self.successors[np.maximum(start - 1, 0)].astype(np.int64), 0)
        found[known] = self.successors.find(word[known] + base[which], start[which], end[which])
        return found

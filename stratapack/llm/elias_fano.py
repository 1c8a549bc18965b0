"""Elias-Fano sequences and a two-level n-gram trie over them, in memory-mapped files.

A sequence of n non-decreasing numbers below U keeps the low bits of each number
verbatim and the high parts in unary: about 2 + log2(U / n) bits a number. A directory of
one 32-bit count for each 64-bit word makes access and successor search a few word
operations, which are done here for many numbers at once.

The trie's first level has the contexts in order; its pointers, which also never
fall, say where each context's successors begin in the second level. There every
successor is stored as its id plus the last value of the context before, so the whole
level never falls, and a look-up searches one context's range for id + base.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

_U = np.uint64
_ALL = ~_U(0)


def _store(folder: str | None, name: str, values: np.ndarray) -> np.ndarray:
    """The array, mapped from a file if there is a folder."""
    if folder is None or not len(values):
        return values
    path = os.path.join(folder, name)
    values.tofile(path)
    return np.memmap(path, values.dtype, "r")


def _kth_one(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word: halve the window six times."""
    place, k, word = np.zeros(len(word), np.uint64), k.astype(np.int64), word.copy()
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & _U((1 << width) - 1)).astype(np.int64)
        over = k >= below
        k = np.where(over, k - below, k)
        shift = np.where(over, _U(width), _U(0))
        word >>= shift
        place += shift
    return place.astype(np.int64)


class EliasFano:
    def __init__(self, values: np.ndarray, universe: int, folder: str | None = None, name: str = "s"):
        """values: non-decreasing, below universe."""
        values = np.asarray(values, np.uint64)
        self.n, self.universe = len(values), int(universe)
        ratio = max(1, self.universe) // max(1, self.n)
        self.low_bits = max(0, ratio.bit_length() - 1)
        low, high = _U(self.low_bits), (values >> _U(self.low_bits)).astype(np.int64)
        bits = np.zeros(self.n * self.low_bits + 64, np.uint8)
        if self.low_bits:
            at = np.arange(self.n, dtype=np.int64) * self.low_bits
            for k in range(self.low_bits):
                bits[at + k] = (values >> _U(k)) & _U(1)
        packed = np.packbits(bits, bitorder="little")
        packed = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8))
        self.low = _store(folder, f"{name}.low", packed.view("<u8"))
        size = self.n + (self.universe >> self.low_bits) + 2
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[high + np.arange(self.n)] = 1
        words = np.packbits(unary, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.high = _store(folder, f"{name}.high", words)
        self.ones = _store(folder, f"{name}.ones", ones.astype(np.uint32 if ones[-1] < 1 << 32 else np.uint64))
        del low

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ones.nbytes

    def _select1(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k.astype(self.ones.dtype), "right") - 1
        return word * 64 + _kth_one(self.high[word], k - self.ones[word].astype(np.int64))

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero: halve the directory on 64 * word - ones."""
        low, high = np.zeros(len(k), np.int64), np.full(len(k), len(self.high), np.int64)
        for _ in range(max(1, int(len(self.high)).bit_length())):
            middle = (low + high + 1) >> 1
            middle = np.minimum(middle, len(self.high))
            fits = (middle * 64 - self.ones[middle].astype(np.int64) <= k) & (middle < high)
            low, high = np.where(fits, middle, low), np.where(fits, high, np.maximum(middle, low + 1))
        return low * 64 + _kth_one(self.high[low] ^ _ALL, k - (low * 64 - self.ones[low].astype(np.int64)))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (first | second) & _U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return (self._select1(i) - i).astype(np.uint64) << _U(self.low_bits) | self._low(i)

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the first number >= x in [begin, end) of each query, or end."""
        x = np.asarray(x, np.uint64)
        part = np.minimum(x >> _U(self.low_bits), _U(self.universe >> self.low_bits)).astype(np.int64)
        upto = self._select0(part) - part
        since = np.where(part > 0, self._select0(np.maximum(part - 1, 0)) - np.maximum(part - 1, 0), 0)
        a, b = np.clip(since, begin, end), np.clip(upto, begin, end)
        rest = x & _U((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self._low(middle) < rest[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        return a


class Trie:
    """Contexts -> successors -> one quantised value each."""

    def __init__(self, context: np.ndarray, successor: np.ndarray, codes: np.ndarray, vocabulary: int, folder: str | None = None):
        """Pairs sorted by (context, successor), each once; ids below vocabulary."""
        self.n = len(context)
        if not self.n:
            return
        begins = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        ends = np.append(begins[1:], self.n)
        base = np.concatenate([[0], np.cumsum(successor[ends - 1].astype(np.uint64))[:-1]]).astype(np.uint64)
        raised = successor.astype(np.uint64) + np.repeat(base, ends - begins)
        self.contexts = EliasFano(context[begins], vocabulary, folder, "contexts")
        self.pointers = EliasFano(np.append(begins, self.n), self.n + 1, folder, "pointers")
        self.successors = EliasFano(raised, int(raised[-1]) + 1, folder, "successors")
        self.codes = _store(folder, "codes", codes)

    def nbytes(self) -> int:
        return self.n and self.contexts.nbytes() + self.pointers.nbytes() + self.successors.nbytes() + self.codes.nbytes

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Place of each pair in the second level, or -1. Contexts are best sorted: each is searched once."""
        out = np.full(len(context), -1, np.int64)
        if not self.n or not len(context):
            return out
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        each, times = context[first], np.diff(np.append(first, len(context)))
        n = self.contexts.n
        at = self.contexts.successor(each, np.zeros(len(each), np.int64), np.full(len(each), n))
        known = at < n
        known[known] = self.contexts.access(at[known]) == each[known].astype(np.uint64)
        at = np.where(known, at, 0)
        begin, end = self.pointers.access(at).astype(np.int64), self.pointers.access(at + 1).astype(np.int64)
        base = np.where(begin > 0, self.successors.access(np.maximum(begin - 1, 0)), _U(0))
        ask = np.flatnonzero(np.repeat(known, times))
        begin, end, base = (np.repeat(v, times)[ask] for v in (begin, end, base))
        x = successor[ask].astype(np.uint64) + base
        place = self.successors.successor(x, begin, end)
        hit = np.flatnonzero(place < end)
        hit = hit[self.successors.access(place[hit]) == x[hit]]
        out[ask[hit]] = place[hit]
        return out


class Mapped:
    """A temporary folder for mapped levels; gone when left."""

    def __enter__(self) -> str:
        self.path = tempfile.mkdtemp(prefix="levels-")
        return self.path

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.path, ignore_errors=True)

"""Elias-Fano coded levels of an n-gram trie, in one file that is mapped into memory."""

from __future__ import annotations

import numpy as np

#: Steps of the quantised probabilities, and the largest code; code 0 means absent.
STEPS, LAST = 2048, 65535
_ONE = np.uint64(1)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with a count per word of the bit vector."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.before = n, low_bits, low, high, before

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        size = (n * bits + 63) // 64 + 1
        low = np.zeros(size, dtype=np.uint64)
        if bits:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << off)
            over = np.flatnonzero(off + np.uint64(bits) > np.uint64(64))
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        marks = ((v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        high = np.zeros((int(marks[-1]) if n else 0) // 64 + 2, dtype=np.uint64)
        np.bitwise_or.at(high, marks >> 6, _ONE << (marks & 63).astype(np.uint64))
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))[:-1]])
        return cls(n, bits, low, high, before)

    def _select(self, i: np.ndarray) -> np.ndarray:
        """Position of the i-th set bit of the high part."""
        word = np.searchsorted(self.before, i, side="right") - 1
        left = (i - self.before[word]).astype(np.uint64)
        bits, at = np.array(self.high[word]), np.zeros(len(i), dtype=np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.uint64)
            on = here <= left
            left = np.where(on, left - here, left)
            bits = np.where(on, bits >> np.uint64(half), bits)
            at = np.where(on, at + np.uint64(half), at)
        return word * 64 + at.astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i) - i).astype(np.uint64)
        if not self.low_bits:
            return high
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        low = self.low[word] >> off
        over = off + np.uint64(self.low_bits) > np.uint64(64)
        low = np.where(over, low | (self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63))), low)
        return (high << np.uint64(self.low_bits)) | (low & np.uint64((1 << self.low_bits) - 1))

    def next_geq(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First index in [lo, hi) whose value is at least x, or hi."""
        lo, hi = lo.copy(), hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            less = self.get(mid) < x[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        return lo


class Trie:
    """Contexts, pointers to their successors, successors and codes, each as one level of a mapped file.

    Successors of a context are stored relative to it: the last value of the context before is added, so the
    whole level is monotone, and a search adds the same base.
    """

    @staticmethod
    def write(path: str, keys: np.ndarray, codes: np.ndarray) -> None:
        """*keys*: sorted different pairs, context << 32 | successor; *codes*: one per pair."""
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] >> np.uint64(32)) != (keys[:-1] >> np.uint64(32))])) \
            if len(keys) else np.zeros(0, dtype=np.int64)
        contexts = keys[first] >> np.uint64(32)
        pointers = np.append(first, len(keys))
        word = keys & np.uint64(0xFFFFFFFF)
        last = word[pointers[1:] - 1] + _ONE if len(first) else np.zeros(0, np.uint64)
        bases = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last)])
        follow = word + np.repeat(bases[:-1], np.diff(pointers))
        with open(path, "wb") as f:
            for seq in (contexts, pointers, bases, follow):
                ef = EliasFano.encode(seq)
                np.array([ef.n, ef.low_bits, len(ef.low), len(ef.high)], dtype=np.int64).tofile(f)
                for part in (ef.low, ef.high, ef.before):
                    part.astype(np.int64 if part is ef.before else np.uint64).tofile(f)
            codes.astype(np.uint16).tofile(f)

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        at, levels = 0, []

        def take(kind, n):
            nonlocal at
            size = np.dtype(kind).itemsize * n
            out = raw[at:at + size].view(kind)
            at += size
            return out

        for _ in range(4):
            n, bits, low, high = (int(x) for x in take(np.int64, 4))
            levels.append(EliasFano(n, bits, take(np.uint64, low), take(np.uint64, high), take(np.int64, high)))
        self.contexts, self.pointers, self.bases, self.follow = levels
        self.codes = take(np.uint16, self.follow.n)

    def context(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Successor range and base of each context; an unknown one has an empty range."""
        n = self.contexts.n
        zero = np.zeros(len(word), dtype=np.int64)
        if not n:
            return zero, zero.copy(), zero.astype(np.uint64)
        at = self.contexts.next_geq(word, zero, np.full(len(word), n))
        safe = np.minimum(at, n - 1)
        known = (at < n) & (self.contexts.get(safe) == word)
        lo, hi = self.pointers.get(safe).astype(np.int64), self.pointers.get(safe + 1).astype(np.int64)
        return np.where(known, lo, 0), np.where(known, hi, 0), self.bases.get(safe)

    def find(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Code of each successor within its context's range; 0 if it is not there."""
        if not self.follow.n:
            return np.zeros(len(word), dtype=np.uint16)
        at = self.follow.next_geq(word + base, lo, hi)
        safe = np.minimum(at, self.follow.n - 1)
        there = (at < hi) & (self.follow.get(safe) == word + base)
        return np.where(there, self.codes[safe], 0).astype(np.uint16)


def quantise(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEPS) + 1, LAST).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(float) - 1) / STEPS), 0.0)

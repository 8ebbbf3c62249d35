"""Elias-Fano sequences with vectorised access and successor search, over memory that may be mapped from a file."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

_ONE = np.uint64(1)
_WORDS = 8  # words of 64 bits between two entries of a directory
#: Place of the k-th set bit of a byte.
_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _k, _place in enumerate([p for p in range(8) if _b >> p & 1]):
        _SELECT[_b, _k] = _place


@dataclass
class Bits:
    words: np.ndarray  # uint64, a multiple of _WORDS
    ones: np.ndarray  # set bits before each block of _WORDS words
    zeros: np.ndarray

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        size = -(-max(1, len(flags)) // (64 * _WORDS)) * 64 * _WORDS
        padded = np.ones(size, bool)
        padded[: len(flags)] = flags
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        per_block = np.bitwise_count(words).reshape(-1, _WORDS).sum(axis=1, dtype=np.uint32)
        ones = np.concatenate(([0], np.cumsum(per_block))).astype(np.uint32)
        return cls(words, ones, (np.arange(len(ones)) * 64 * _WORDS - ones).astype(np.uint32))

    def select(self, k: np.ndarray, zero: bool = False) -> np.ndarray:
        """Place of the k-th (from 0) set bit, or zero bit."""
        k = np.asarray(k)
        before = self.zeros if zero else self.ones
        block = np.searchsorted(before, k.astype(np.uint32), "right") - 1
        rest = (k - before[block]).astype(np.int64)
        words = self.words.reshape(-1, _WORDS)[block]
        if zero:
            words = ~words
        sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        at = (sums <= rest[:, None]).sum(axis=1)
        row = np.arange(len(k))
        rest -= np.where(at > 0, sums[row, np.maximum(at - 1, 0)], 0)
        octets = np.ascontiguousarray(words[row, at]).view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        byte = (sums <= rest[:, None]).sum(axis=1)
        rest -= np.where(byte > 0, sums[row, np.maximum(byte - 1, 0)], 0)
        return (block * _WORDS + at) * 64 + byte * 8 + _SELECT[octets[row, byte], rest]

    def following(self, at: np.ndarray, k: np.ndarray, zero: bool = False) -> np.ndarray:
        """Place of the k-th bit of its kind, which is the next after a place: looked for in the 64 bits behind that, else by select."""
        word, shift = (at + 1) >> 6, ((at + 1) & 63).astype(np.uint64)
        last = len(self.words) - 1
        bits = (self.words[np.minimum(word, last)] >> shift) | ((self.words[np.minimum(word + 1, last)] << (np.uint64(63) - shift)) << _ONE)
        if zero:
            bits = ~bits
        lowest = bits & (~bits + _ONE)
        out = at + 1 + np.bitwise_count(lowest - _ONE)
        far = np.flatnonzero((bits == 0) | (out >> 6 > last))
        if len(far):
            out[far] = self.select(k[far], zero)
        return out


class EliasFano:
    """A nondecreasing sequence of n unsigned numbers: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: Bits):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.mask = np.uint64((1 << low_bits) - 1)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero((at & 63) + bits > 64)
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(places[-1]) if n else 0) + 2, bool)
        flags[places] = True
        return cls(n, bits, low, Bits.of(flags))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        # A shift by 64 is split in two, as numpy leaves it undefined.
        return ((self.low[word] >> shift) | ((self.low[word + 1] << (np.uint64(63) - shift)) << _ONE)) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self.high.select(i) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def access_pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements i and i + 1."""
        if not len(i):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at = self.high.select(i)
        after = self.high.following(at, i + 1)
        bits = np.uint64(self.low_bits)
        return ((at - i).astype(np.uint64) << bits) | self._low(i), ((after - i - 1).astype(np.uint64) << bits) | self._low(i + 1)

    def find(self, target: np.ndarray, start: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """Index of target in [start, end), or -1: successor search among the elements with its high bits."""
        m = len(target)
        if not m or not self.n:
            return np.full(m, -1, np.int64)
        target = target.astype(np.uint64)
        high = (target >> np.uint64(self.low_bits)).astype(np.int64)
        most = int(self.high.zeros[-1])  # zero bits in all
        inside = high < most
        high = np.minimum(high, most - 1)
        # The zero before the elements with these high bits, and the one behind them.
        before = np.where(high > 0, self.high.select(np.maximum(high - 1, 0), True), -1)
        lo = before - high + 1
        hi = self.high.following(before, high, True) - high
        lo = np.maximum(lo, start)
        hi = np.minimum(hi, self.n if end is None else end)
        want = target & self.mask
        stop = hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < want[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
        ok = np.flatnonzero(inside & (lo < stop))
        found = np.full(m, -1, np.int64)
        hit = ok[self._low(lo[ok]) == want[ok]]
        found[hit] = lo[hit]
        return found

    def parts(self) -> tuple[dict, list[np.ndarray]]:
        return {"n": self.n, "low_bits": self.low_bits}, [self.low, self.high.words, self.high.ones, self.high.zeros]

    @classmethod
    def from_parts(cls, about: dict, arrays: list[np.ndarray]) -> EliasFano:
        return cls(about["n"], about["low_bits"], arrays[0], Bits(*arrays[1:4]))


def packed(about: dict, arrays: list[np.ndarray]) -> bytes:
    """Arrays behind a header, each at a multiple of 8 bytes, so that a mapped file serves as their memory."""
    head, at, body = [], 0, []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        raw += b"\0" * (-len(raw) % 8)
        head.append([a.dtype.str, len(a), at])
        body.append(raw)
        at += len(raw)
    text = json.dumps(about | {"arrays": head}).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def unpacked(memory: np.ndarray) -> tuple[dict, list[np.ndarray]]:
    """The header and views of the arrays in memory (bytes)."""
    size = int.from_bytes(memory[:8].tobytes(), "little")
    about = json.loads(memory[8 : 8 + size].tobytes())
    body = memory[8 + size :]
    return about, [body[at : at + n * np.dtype(kind).itemsize].view(kind) for kind, n, at in about["arrays"]]

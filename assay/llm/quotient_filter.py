"""Counting quotient filters of packed word ids, without loss.

An n-gram of word ids is packed into 2 * ``half`` bits and permuted by a Feistel network, which
can be inverted. The permuted number's first bits are the quotient, which is not stored but is
the place in the filter (occupied slots and ends of runs, a bit each); all its other bits are
the remainder, so that two n-grams are never taken for each other. Entries are sorted by the
permuted number: filters are merged like sorted lists, and a filter cuts at any bits of the
quotient.
"""

from __future__ import annotations

import struct

import numpy as np

from assay.llm.words import U, mix

#: One odd number a round.
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_HEAD = struct.Struct("<QBBBB")


class Packing:
    """Packed n-grams of ids of ``bits`` bits (1 to 32)."""

    def __init__(self, n: int, bits: int):
        self.n, self.bits = n, bits
        self.low = bits // 2  # bits of a middle word in the right half
        self.half = {1: bits, 2: bits, 3: bits + bits - self.low, 4: 2 * bits}[n]
        self.mask = U((1 << self.half) - 1)

    def pack(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        w, b = [x.astype(U) for x in words], U(self.bits)
        if self.n == 2:
            return w[0], w[1]
        if self.n == 3:
            low = U(self.low)
            return w[0] << (b - low) | w[1] >> low, (w[1] & U((1 << self.low) - 1)) << b | w[2]
        return w[0] << b | w[1], w[2] << b | w[3]

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        b, one = U(self.bits), U((1 << self.bits) - 1)
        if self.n == 2:
            return [left, right]
        if self.n == 3:
            low = U(self.low)
            high = U(self.bits - self.low)
            return [left >> high, (left & U((1 << (self.bits - self.low)) - 1)) << low | right >> b, right & one]
        return [left >> b, left & one, right >> b, right & one]

    def permute(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in ROUNDS:
            left, right = right, left ^ (mix(right + U(k)) & self.mask)
        return left, right

    def invert(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in reversed(ROUNDS):
            left, right = right ^ (mix(left + U(k)) & self.mask), left
        return left, right

    def order(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if 2 * self.half <= 64:
            return np.argsort(left << U(self.half) | right, kind="stable")
        return np.lexsort((right, left))

    def counted(self, left, right, counts=None):
        """Sorted distinct numbers with their counts, and for each given number its place."""
        order = self.order(left, right)
        x, y = left[order], right[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        first = np.flatnonzero(new)
        which = np.empty(len(x), np.int64)
        which[order] = np.cumsum(new) - 1
        if counts is None:
            total = np.diff(np.append(first, len(x)))
        else:
            total = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
        return x[first], y[first], total, which


def _planes(x: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each number, whole bytes, byte by byte of all numbers."""
    width = -(-bits // 8)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(raw: memoryview, n: int, bits: int) -> tuple[np.ndarray, int]:
    width = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(U), n * width


def write(packing: Packing, left: np.ndarray, right: np.ndarray, counts: np.ndarray, shard_bits: int) -> bytes:
    """A filter of sorted distinct numbers that share their first ``shard_bits`` bits."""
    n = len(left)
    slots = min(packing.half - shard_bits, max(0, int(n).bit_length()))
    rest = packing.half - shard_bits - slots
    quotient = ((left >> U(rest)) & U((1 << slots) - 1)).astype(np.int64)
    occupied, ends = np.zeros(1 << slots, bool), np.ones(n, bool)
    occupied[quotient] = True
    ends[:-1] = quotient[1:] != quotient[:-1]
    small = np.minimum(counts - 1, 255).astype(np.uint8)
    large = np.flatnonzero(small == 255)
    return b"".join((_HEAD.pack(n, packing.half, shard_bits, slots, 0), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                     _planes(left & U((1 << rest) - 1), rest), _planes(right, packing.half), small.tobytes(),
                     counts[large].astype("<i8").tobytes()))


def read(raw: bytes, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The filter's numbers, sorted, and their counts."""
    view = memoryview(raw)
    n, half, shard_bits, slots, _ = _HEAD.unpack_from(view)
    rest = half - shard_bits - slots
    at = _HEAD.size
    size = -(-(1 << slots) // 8)
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(view, np.uint8, size, at), count=1 << slots))
    at += size
    size = -(-n // 8)
    ends = np.unpackbits(np.frombuffer(view, np.uint8, size, at), count=n).astype(np.int64)
    at += size
    quotient = occupied[np.cumsum(ends) - ends].astype(U)
    low, size = _numbers(view[at:], n, rest)
    at += size
    right, size = _numbers(view[at:], n, half)
    at += size
    counts = np.frombuffer(view, np.uint8, n, at).astype(np.int64) + 1
    at += n
    large = np.flatnonzero(counts == 256)
    counts[large] = np.frombuffer(view, "<i8", len(large), at)
    return (U(shard) << U(slots) | quotient) << U(rest) | low, right, counts

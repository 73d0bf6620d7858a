"""Counting quotient filters: lossless counters of whole-number keys."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

_ROUNDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_HEAD = "<BBBxqq"


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _mixed(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = (x + factor) * factor
    x = (x ^ (x >> np.uint64(32))) * _ROUNDS[2]
    return x ^ (x >> np.uint64(29))


def permute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A fixed bijection of the numbers of 2 * ``half`` bits, given as halves:
    the upper half of the result falls evenly whatever the keys are."""
    for factor in _ROUNDS:
        high, low = low, high ^ (_mixed(low, factor) & _mask(half))
    return high, low


def restore(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves that ``permute`` was given."""
    for factor in reversed(_ROUNDS):
        high, low = low ^ (_mixed(high, factor) & _mask(half)), high
    return high, low


def in_order(high: np.ndarray, low: np.ndarray, half: int) -> np.ndarray:
    """Order by upper, then lower half; sorted runs are merged, not sorted again."""
    if 2 * half <= 64:
        return np.argsort((high << np.uint64(half)) | low if half < 64 else high, kind="stable")
    return np.lexsort((low, high))


def _bits(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each number: whole bytes, then single bits."""
    whole = width // 8
    out = [np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :whole].T.tobytes()]
    out += [np.packbits((values >> np.uint64(b)) & np.uint64(1) > 0).tobytes() for b in range(8 * whole, width)]
    return b"".join(out)


def _numbers(data: memoryview, n: int, width: int) -> tuple[np.ndarray, memoryview]:
    whole, plane = width // 8, (n + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :whole] = np.frombuffer(data[:whole * n], np.uint8).reshape(whole, n).T
    values, data = out.view("<u8").ravel(), data[whole * n:]
    for b in range(8 * whole, width):
        values |= np.unpackbits(np.frombuffer(data[:plane], np.uint8), count=n).astype(np.uint64) << np.uint64(b)
        data = data[plane:]
    return values, data


def _flags(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    size = (n + 7) // 8
    return np.unpackbits(np.frombuffer(data[:size], np.uint8), count=n).astype(bool), data[size:]


class QuotientFilter:
    """Counts of permuted keys that share their first ``shared`` bits.

    A key's quotient, its next ``quotient`` bits, says where it stands: one
    bit per quotient tells whether it has keys, one bit per key whether it is
    the last of its quotient. Only the remainder, all bits behind the
    quotient, is stored, so a key is known exactly. A bit marks keys counted
    more than once; only these have a counter, of as many bytes as it needs.
    """

    def __init__(self, half: int, shared: int, quotient: int, prefix: int, occupied: np.ndarray, ends: np.ndarray,
                 high: np.ndarray, low: np.ndarray, counts: np.ndarray):
        self.half, self.shared, self.quotient, self.prefix = half, shared, quotient, prefix
        self.occupied, self.ends, self.high, self.low, self.counts = occupied, ends, high, low, counts

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, shared: int = 0) -> QuotientFilter:
        """From sorted different permuted keys."""
        n = len(high)
        quotient = min(half - shared, max(n - 1, 0).bit_length())
        left = half - shared - quotient
        at = ((high >> np.uint64(left)) & _mask(quotient)).astype(np.int64)
        occupied = np.zeros(1 << quotient, bool)
        occupied[at] = True
        prefix = int(high[0] >> np.uint64(half - shared)) if shared and n else 0
        return cls(half, shared, quotient, prefix, occupied, np.append(at[1:] != at[:-1], True)[:n], high & _mask(left), low, counts)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted permuted keys, as halves, and their counts."""
        left = self.half - self.shared - self.quotient
        run = np.cumsum(self.ends) - self.ends
        at = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        above = np.uint64(self.prefix << (self.half - self.shared)) if self.shared else np.uint64(0)
        return above | (at << np.uint64(left)) | self.high, self.low, self.counts

    def count(self, high: int, low: int) -> int:
        """Count of one permuted key: its quotient's rank among the occupied
        ones gives its run, in which its remainder is looked up."""
        left = self.half - self.shared - self.quotient
        if self.shared and high >> (self.half - self.shared) != self.prefix:
            return 0
        q = high >> left & (1 << self.quotient) - 1
        if not self.occupied[q]:
            return 0
        run = int(self.occupied[:q].sum())
        last = np.flatnonzero(self.ends)
        lo, hi = int(last[run - 1]) + 1 if run else 0, int(last[run]) + 1
        found = np.flatnonzero((self.high[lo:hi] == np.uint64(high & (1 << left) - 1)) & (self.low[lo:hi] == np.uint64(low)))
        return int(self.counts[lo + found[0]]) if len(found) else 0

    def to_bytes(self) -> bytes:
        n = len(self.high)
        often = self.counts > 1
        rest = self.counts[often].astype(np.uint64) - np.uint64(2)
        width = np.ones(len(rest), np.int64)
        for b in range(1, 8):
            width += rest >= np.uint64(1 << 8 * b)
        counters = rest.astype("<u8").view(np.uint8).reshape(-1, 8)
        return b"".join([
            struct.pack(_HEAD, self.half, self.shared, self.quotient, self.prefix, n),
            np.packbits(self.occupied).tobytes(), np.packbits(self.ends).tobytes(),
            _bits(self.high, self.half - self.shared - self.quotient), _bits(self.low, self.half), np.packbits(often).tobytes(),
            _bits((width - 1).astype(np.uint64), 3), counters[np.arange(8) < width[:, None]].tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        half, shared, quotient, prefix, n = struct.unpack_from(_HEAD, data)
        rest = memoryview(data)[struct.calcsize(_HEAD):]
        occupied, rest = _flags(rest, 1 << quotient)
        ends, rest = _flags(rest, n)
        high, rest = _numbers(rest, n, half - shared - quotient)
        low, rest = _numbers(rest, n, half)
        often, rest = _flags(rest, n)
        more = int(often.sum())
        width, rest = _numbers(rest, more, 3)
        counters = np.zeros((more, 8), np.uint8)
        counters[np.arange(8) <= width[:, None].astype(np.int64)] = np.frombuffer(rest, np.uint8)
        counts = np.ones(n, np.int64)
        counts[often] = counters.view("<u8").ravel().astype(np.int64) + 2
        return cls(half, shared, quotient, prefix, occupied, ends, high, low, counts)


def counted(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys with their summed counts (none: 1 each)."""
    order = in_order(high, low, half)
    high, low = high[order], low[order]
    first = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[:len(high)])
    if counts is None:
        sums = np.diff(np.append(first, len(high)))
    else:
        sums = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return high[first], low[first], sums


def merged(filters: Sequence[QuotientFilter]) -> QuotientFilter:
    """One filter of the keys of several with the same halves and shared bits."""
    parts = [f.entries() for f in filters]
    high, low, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return QuotientFilter.of(*counted(high, low, counts, filters[0].half), filters[0].half, filters[0].shared)

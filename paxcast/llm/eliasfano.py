"""Elias-Fano sequences over mapped memory (used by operator 1).

A non-decreasing sequence of numbers is split into high and low parts. The high
parts are a bit vector, a one per element and a zero per high value, so the
zeros are monotone pointers: between zero h-1 and zero h stand the elements of
high value h. The low parts are stored plainly. Lookups are batched: arrays of
queries walk the structure together.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the r-th zero of a byte (lowest bit first).
ZERO_AT = np.array([[*(i for i in range(8) if not b >> i & 1), *[8] * bin(b).count("1")] for b in range(256)], np.uint8)


def encode(high: np.ndarray, low: np.ndarray, highs: int) -> dict[str, np.ndarray]:
    """The arrays of a sequence whose elements are (high, low), sorted; ``low``
    has at most 48 bits."""
    bits = np.zeros(-(-(len(high) + highs) // 64) * 64, np.uint8)
    bits[high + np.arange(len(high))] = 1
    bits[len(high) + highs:] = 1
    zeros = 64 - bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
    before = (np.cumsum(zeros) - zeros).astype(np.uint32)
    return {"upper": np.packbits(bits, bitorder="little"), "before": before,
            "low": low.astype(np.uint32), "more": (low >> np.uint64(32)).astype(np.uint16)}


def zero(arrays, rank: np.ndarray) -> np.ndarray:
    """Place of the zero with each rank."""
    word = np.searchsorted(arrays["before"], rank, side="right") - 1
    left = rank - arrays["before"][word].astype(np.int64)
    octets = arrays["upper"].reshape(-1, 8)[word]
    sums = np.cumsum(8 - ONES[octets], axis=1, dtype=np.int64)
    octet = (sums <= left[:, None]).sum(axis=1)
    at = np.arange(len(rank))
    left -= np.where(octet > 0, sums[at, octet - 1], 0)
    return word * 64 + octet * 8 + ZERO_AT[octets[at, octet], left]


def children(arrays, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First element of each high value, and the one behind its last."""
    first = np.zeros(len(high), np.int64)
    some = high > 0
    first[some] = zero(arrays, high[some] - 1) - (high[some] - 1)
    return first, zero(arrays, high) - high


def find(arrays, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Index of each (high, low), or -1: a successor search among the children of
    ``high`` only."""
    out = np.full(len(high), -1, np.int64)
    if not len(high) or not len(arrays["low"]):
        return out
    begin, end = children(arrays, high)
    stop = end.copy()
    active = np.flatnonzero(begin < end)
    while len(active):
        middle = (begin[active] + end[active]) >> 1
        less = value(arrays, middle) < low[active]
        begin[active] = np.where(less, middle + 1, begin[active])
        end[active] = np.where(less, end[active], middle)
        active = active[begin[active] < end[active]]
    hit = np.flatnonzero(begin < stop)
    hit = hit[value(arrays, begin[hit]) == low[hit]]
    out[hit] = begin[hit]
    return out


def value(arrays, at: np.ndarray) -> np.ndarray:
    return arrays["more"][at].astype(np.uint64) << np.uint64(32) | arrays["low"][at]


class Mapped:
    """Arrays of named levels in one memory-mapped file without a name: its pages
    can leave memory, and nothing stays when the task ends, however it ends."""

    def __init__(self, levels: dict[str, dict[str, np.ndarray]]):
        places, size = {}, 0
        for level, arrays in levels.items():
            for name, array in arrays.items():
                size += -size % 8
                places[level, name] = (size, array)
                size += array.nbytes
        self.bytes = size
        self.file = tempfile.TemporaryFile()
        self.file.truncate(max(8, size))
        self.map = mmap.mmap(self.file.fileno(), max(8, size))
        self.levels: dict[str, dict[str, np.ndarray]] = {}
        for (level, name), (at, array) in places.items():
            view = np.frombuffer(self.map, array.dtype, array.size, at)
            if array.size:
                np.frombuffer(self.map, array.dtype, array.size, at)[:] = array
            self.levels.setdefault(level, {})[name] = view

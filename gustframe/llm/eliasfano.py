"""Elias-Fano code of a non-decreasing sequence: about 2 + log2(universe / n) bits a value, with select."""

from __future__ import annotations

import struct

import numpy as np

#: Every STEP-th one of the upper bits has its place in the directory (32 bits each).
STEP = 512


def encode(values: np.ndarray) -> bytes:
    """Values are non-decreasing, from 0; bits below 2**32 upper places (a shard is far smaller)."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) + 1 if n else 0
    width = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
    high = (values >> np.uint64(width)).astype(np.int64)
    places = high + np.arange(n)
    upper = np.zeros((int(places[-1]) + 1 if n else 0), np.uint8)
    upper[places] = 1
    lower = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    packed = np.packbits(upper, bitorder="little").tobytes(), np.packbits(lower, bitorder="little").tobytes()
    directory = places[::STEP].astype("<u4").tobytes()
    return struct.pack("<QIIII", n, width, len(packed[0]), len(packed[1]), len(directory)) + packed[0] + packed[1] + directory


class EliasFano:
    """Reader of one code at the start of ``data``; ``size`` is the number of its bytes."""

    HEAD = struct.calcsize("<QIIII")

    def __init__(self, data: memoryview | bytes):
        self.n, self.width, a, b, c = struct.unpack_from("<QIIII", data)
        self.upper = np.frombuffer(data, np.uint8, a, self.HEAD)
        self.lower = np.frombuffer(data, np.uint8, b, self.HEAD + a)
        self.directory = np.frombuffer(data, "<u4", c // 4, self.HEAD + a + b)
        self.size = self.HEAD + a + b + c

    def select(self, i: int) -> int:
        """The i-th value: one directory entry, a count of ones in a short stretch, and the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rank = int(self.directory[i // STEP]), i - i % STEP
        byte = at // 8
        rank -= int(np.bitwise_count(np.uint8(self.upper[byte] & ((1 << at % 8) - 1))))
        while True:
            counts = np.cumsum(np.bitwise_count(self.upper[byte:byte + 256]), dtype=np.int64)
            k = int(np.searchsorted(counts, i - rank, side="right"))
            if k < len(counts):
                break
            rank += int(counts[-1])
            byte += len(counts)
        rank += int(counts[k - 1]) if k else 0
        ones = np.flatnonzero(np.unpackbits(self.upper[byte + k:byte + k + 1], bitorder="little"))
        place = (byte + k) * 8 + int(ones[i - rank])
        first = i * self.width
        bits = np.unpackbits(self.lower[first // 8:(first + self.width + 7) // 8], bitorder="little")[first % 8:first % 8 + self.width]
        return ((place - i) << self.width) | sum(int(b) << k for k, b in enumerate(bits))

    def select_run(self, first: int, last: int) -> np.ndarray:
        """The values ``first`` to ``last`` - 1: found as by ``select``, then read on; only this run is held."""
        n = min(last, self.n) - first
        if n <= 0:
            return np.zeros(0, np.uint64)
        at, skipped = int(self.directory[first // STEP]), first % STEP
        end = (first + n - 1) // STEP + 1
        stop = int(self.directory[end]) // 8 + 1 if end < len(self.directory) else len(self.upper)
        bits = np.unpackbits(self.upper[at // 8:stop], bitorder="little")
        bits[:at % 8] = 0
        places = np.flatnonzero(bits)[skipped:skipped + n] + at // 8 * 8
        out = (places - np.arange(first, first + n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            low = first * self.width
            bits = np.unpackbits(self.lower[low // 8:((first + n) * self.width + 7) // 8], bitorder="little")
            bits = bits[low % 8:low % 8 + n * self.width].reshape(n, self.width)
            for k in range(self.width):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

"""64-bit hashes of all words of a batch of texts, computed on the bytes with numpy.

A word's hash is sum(code[byte] * P**position) over its bytes, taken from one running sum over the
buffer and divided by P**start (P is odd, so it has an inverse modulo 2**64). Codes are random
64-bit numbers; a byte class (separator, letter case) is only an entry of the code table.
"""

from __future__ import annotations

import numpy as np

P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 2**64)
BLOCK = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

ASCII_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: All ASCII but digits and letters; capitals are lower-cased first, so they are no separators.
ASCII_NO_WORD = bytes(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Hashes of words between ``separators``, A-Z read as a-z; of their first bytes too for each length in ``prefixes``."""

    def __init__(self, separators: bytes = ASCII_SPACE, prefixes: tuple[int, ...] = ()):
        self.prefixes = prefixes
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        codes = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
        codes[0x41:0x5B] = codes[0x61:0x7B]
        self.codes = codes
        self.cut = min(separators)
        self._grow(2 * BLOCK)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(P, n), _powers(P_INVERSE, n)

    def spans(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in a buffer of bytes."""
        gap = np.empty(len(buffer) + 2, bool)
        gap[0] = gap[-1] = True
        np.take(self.separator, buffer, out=gap[1:-1])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        return edge[::2], edge[1::2]

    def _hash(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(buffer) > len(self.up):
            self._grow(len(buffer))      # one word longer than a block
        start, end = self.spans(buffer)
        total = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(self.codes[buffer] * self.up[:len(buffer)], out=total[1:])
        ends = [end, *(np.minimum(start + n, end) for n in self.prefixes)]
        own = [mix((total[e] - total[start]) * self.down[start]) for e in ends]
        return start, np.stack(own, axis=1) if self.prefixes else own[0]

    def _blocks(self, text: bytes):
        """Pieces of a long text, cut at separators."""
        buffer = np.frombuffer(text, np.uint8)
        start = 0
        while start < len(buffer):
            end = start + BLOCK
            if end < len(buffer):
                gaps = np.flatnonzero(self.separator[buffer[start:end]])
                if len(gaps):
                    end = start + int(gaps[-1]) + 1
                else:
                    while end < len(buffer) and not self.separator[buffer[end]]:
                        end += 1
            yield buffer[start:end]
            start = end

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts in order (with prefixes: a row each), and the number of words of each text."""
        parts, counts = [], np.zeros(len(texts), np.int64)
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (held == 0 or held + len(texts[j]) < BLOCK):
                held += len(texts[j]) + 1
                j += 1
            if held > BLOCK:
                for block in self._blocks(texts[i]):
                    h = self._hash(block)[1]
                    counts[i] += len(h)
                    parts.append(h)
                i += 1
                continue
            sizes = np.fromiter((len(t) + 1 for t in texts[i:j]), np.int64, j - i)
            buffer = np.frombuffer(bytes([self.cut]).join(texts[i:j]), np.uint8)
            start, h = self._hash(buffer)
            at = np.searchsorted(start, np.cumsum(sizes))
            counts[i:j] = np.diff(at, prepend=0)
            parts.append(h)
            i = j
        none = np.zeros((0, 1 + len(self.prefixes)) if self.prefixes else 0, np.uint64)
        return (np.concatenate(parts) if parts else none), counts

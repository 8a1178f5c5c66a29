"""Wavelet matrix over 16-bit token ids: bit planes with rank and select, kept in one compressed blob."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

PLANES = 16
#: Bits of a plane that are compressed together; the ones before each such chunk are stored beside it.
CHUNK = 1 << 15
_HEAD = struct.Struct("<4sQ")
_MAGIC = b"WMX2"


class WaveletMatrix:
    """Plane k holds bit 15 - k of every id; ids with a 0 there go before those with a 1 in the next plane.

    access(i), rank(token, i), select(token, k) and count(token) read one bit, or one count of ones, a plane:
    the stored count before a chunk and the bits of that chunk, which alone is inflated. The blob is the
    number of ids, for each chunk of each plane its place in the blob, for each plane the ones before each of
    its chunks and in all, and the chunks.
    """

    def __init__(self, n: int, ones: np.ndarray, at: np.ndarray, body: bytes | memoryview):
        self.n, self.ones, self._at, self._body = n, ones, at, body
        self._chunks: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        y, n = ids.astype(np.uint16), len(ids)
        count = -(-n // CHUNK)
        ones, at, body = np.zeros((PLANES, count + 1), np.int64), np.zeros(PLANES * count + 1, np.int64), []
        for k in range(PLANES):
            bits = ((y >> np.uint16(PLANES - 1 - k)) & np.uint16(1)).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            for c in range(count):
                part = packed[c * CHUNK // 8 : (c + 1) * CHUNK // 8]
                ones[k, c + 1] = ones[k, c] + np.bitwise_count(part).sum(dtype=np.int64)
                body.append(pa.compress(part.tobytes(), codec="zstd", asbytes=True))
                at[k * count + c + 1] = at[k * count + c] + len(body[-1])
            y = np.concatenate([y.take(np.flatnonzero(~bits)), y.take(np.flatnonzero(bits))])
        return cls(n, ones, at, b"".join(body))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(_MAGIC, self.n) + self._at.astype("<u4").tobytes() + self.ones.astype("<u4").tobytes() + bytes(self._body)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        magic, n = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        count = -(-n // CHUNK)
        at = np.frombuffer(blob, "<u4", PLANES * count + 1, _HEAD.size)
        ones = np.frombuffer(blob, "<u4", PLANES * (count + 1), _HEAD.size + at.nbytes).reshape(PLANES, count + 1)
        return cls(n, ones.astype(np.int64), at.astype(np.int64), memoryview(blob)[_HEAD.size + at.nbytes + ones.nbytes :])

    def _inflated(self, k: int, c: int) -> np.ndarray:
        j = k * (self.ones.shape[1] - 1) + c
        size = (min(CHUNK, self.n - c * CHUNK) + 7) // 8
        return np.frombuffer(pa.decompress(pa.py_buffer(self._body[self._at[j] : self._at[j + 1]]), decompressed_size=size, codec="zstd", asbytes=True), np.uint8)

    def _chunk(self, k: int, c: int) -> np.ndarray:
        if (k, c) not in self._chunks:
            self._chunks[k, c] = self._inflated(k, c)
        return self._chunks[k, c]

    def _rank1(self, k: int, i: int) -> int:
        c, j = divmod(i, CHUNK)
        if not j:
            return int(self.ones[k, c])
        part = self._chunk(k, c)
        ones = int(self.ones[k, c]) + int(np.bitwise_count(part[: j // 8]).sum(dtype=np.int64))
        return ones + ((int(part[j // 8]) & ((1 << j % 8) - 1)).bit_count() if j % 8 else 0)

    def _zeros(self, k: int) -> int:
        return self.n - int(self.ones[k, -1])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(PLANES):
            bit = int(self._chunk(k, i // CHUNK)[i % CHUNK // 8]) >> i % 8 & 1
            ones = self._rank1(k, i)
            value, i = value << 1 | bit, self._zeros(k) + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """How often token stands before place i."""
        lo, hi = 0, min(max(i, 0), self.n)
        for k in range(PLANES):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self._zeros(k) + a, self._zeros(k) + b) if token >> (PLANES - 1 - k) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Place of the j-th occurrence of token, from 0; IndexError beyond the last."""
        lo, path = 0, []
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        for k in range(PLANES):
            path.append(lo)
            ones = self._rank1(k, lo)
            lo = self._zeros(k) + ones if token >> (PLANES - 1 - k) & 1 else lo - ones
        at = lo + j
        for k in range(PLANES - 1, -1, -1):
            bit = token >> (PLANES - 1 - k) & 1
            at = self._select_bit(k, bit, at - self._zeros(k) if bit else at)
        return at

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        ones = self.ones[k]
        counts = ones if bit else np.minimum(np.arange(len(ones)) * CHUNK, self.n) - ones
        c = int(np.searchsorted(counts, j, side="right")) - 1
        bits = np.unpackbits(self._chunk(k, c), bitorder="little")[: self.n - c * CHUNK]
        return c * CHUNK + int(np.flatnonzero(bits == bit)[j - int(counts[c])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the last to the first."""
        z = np.zeros(self.n, np.uint16)
        for b in range(PLANES if self.n else 0):
            k = PLANES - 1 - b
            plane = np.concatenate([self._inflated(k, c) for c in range(self.ones.shape[1] - 1)])
            bits = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            at0, at1 = np.flatnonzero(~bits), np.flatnonzero(bits)
            y = np.empty_like(z)
            y[at0] = z[: len(at0)]
            y[at1] = z[len(at0) :] | np.uint16(1 << b)
            z = y
        return z

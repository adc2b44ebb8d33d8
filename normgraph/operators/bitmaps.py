"""Compressed bitmaps over 32-bit codes, for set algebra on encoded keys.

Codes are split in a high and a low half of 16 bits. Each high half has one
container: a sorted array of the low halves while it is sparse, else a bitmap
of 65,536 bits. Containers change form at the size where both take 8 KB.
"""

from __future__ import annotations

import numpy as np

_DENSE_FROM = 4096
_BYTES = 8192


def _pack(low: np.ndarray) -> np.ndarray:
    """Container of sorted distinct low halves: uint16 values, or uint8 bits if dense."""
    if len(low) < _DENSE_FROM:
        return low.astype(np.uint16)
    bits = np.zeros(65536, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little")


def _bits(c: np.ndarray) -> np.ndarray:
    if c.dtype == np.uint8:
        return c
    bits = np.zeros(65536, dtype=np.uint8)
    bits[c] = 1
    return np.packbits(bits, bitorder="little")


def _values(c: np.ndarray) -> np.ndarray:
    if c.dtype == np.uint16:
        return c
    return np.flatnonzero(np.unpackbits(c, bitorder="little"))


class CompressedBitmap:
    """Set of codes in [0, 2**32). Supports union, AND NOT, decoding and serialised size."""

    __slots__ = ("parts",)

    def __init__(self, codes: np.ndarray | None = None):
        self.parts: dict[int, np.ndarray] = {}
        if codes is not None and len(codes):
            codes = np.unique(np.asarray(codes, dtype=np.int64))
            high = codes >> 16
            cuts = np.flatnonzero(np.diff(high)) + 1
            for chunk in np.split(codes, cuts):
                self.parts[int(chunk[0] >> 16)] = _pack(chunk & 0xFFFF)

    def update(self, other: "CompressedBitmap") -> None:
        """Union in place."""
        for h, c in other.parts.items():
            mine = self.parts.get(h)
            if mine is None:
                self.parts[h] = c
            elif mine.dtype == np.uint16 and c.dtype == np.uint16:
                self.parts[h] = _pack(np.union1d(mine, c).astype(np.int64))
            else:
                self.parts[h] = _bits(mine) | _bits(c)

    def and_not(self, other: "CompressedBitmap") -> "CompressedBitmap":
        out = CompressedBitmap()
        for h, c in self.parts.items():
            theirs = other.parts.get(h)
            if theirs is None:
                out.parts[h] = c
                continue
            if c.dtype == np.uint16:
                packed = _bits(theirs)
                keep = ((packed[c >> 3] >> (c & 7).astype(np.uint8)) & 1) == 0
                left = c[keep]
            else:
                left = _values(c & ~_bits(theirs))
            if len(left):
                out.parts[h] = _pack(left.astype(np.int64))
        return out

    def decode(self) -> np.ndarray:
        """Codes in ascending order."""
        if not self.parts:
            return np.empty(0, dtype=np.int64)
        return np.concatenate([(h << 16) + _values(self.parts[h]).astype(np.int64) for h in sorted(self.parts)])

    def nbytes(self) -> int:
        return sum(c.nbytes for c in self.parts.values())

    def __len__(self) -> int:
        return sum(len(_values(c)) for c in self.parts.values())

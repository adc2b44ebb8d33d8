"""Hash families and banding curves shared by the sketching operators."""

from __future__ import annotations

import math

import numpy as np

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads 64-bit integers evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def collision(similarity: float, rows: int, bands: int) -> float:
    """Probability that a pair of this similarity shares a band."""
    return 1 - (1 - similarity**rows) ** bands


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Fewest bands of ``rows`` hashes whose collision curve reaches ``recall`` at ``similarity``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def most_unequal(similarity: float, samples: int, loss: float) -> int:
    """The most of ``samples`` two-bit samples that a pair of this similarity may differ in, but for a share of ``loss`` of such pairs."""
    p, tail, most = 0.75 * (1 - similarity), 0.0, samples
    while most > 0 and tail + (term := math.comb(samples, most) * p**most * (1 - p) ** (samples - most)) <= loss:
        tail, most = tail + term, most - 1
    return most


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """(n, bands * rows) hash minima to (n, bands) 64-bit keys, distinct between bands."""
    n, total = minima.shape
    bands = total // rows
    m = mix64(minima.reshape(n, bands, rows))
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return key.view(np.int64)

"""Words, word hashes and runs of words, as the training-data operators define them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import regex
import xxhash

from normgraph.llm.hashing import mix64

#: A word is a maximal run of letters, combining marks and digits (numerals of any kind).
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHasher:
    """64-bit hashes of the lower-cased words of texts, with a bounded memory of words seen."""

    def __init__(self, keep: int = 500_000):
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.hashes = np.empty(0, dtype=np.uint64)

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, one after the other, and the number of words of each."""
        if len(self.seen) > self.keep:
            self._forget()
        seen, find, places, new = self.seen, WORD.findall, [], []
        for t in texts:
            words = find(t.lower()) if t else ()
            try:
                places.append(np.fromiter(map(seen.__getitem__, words), dtype=np.int32, count=len(words)))
            except KeyError:
                for w in words:
                    if w not in seen:
                        seen[w] = len(seen)
                        new.append(xxhash.xxh64_intdigest(w))
                places.append(np.fromiter(map(seen.__getitem__, words), dtype=np.int32, count=len(words)))
        if new:
            self.hashes = np.concatenate([self.hashes, np.array(new, dtype=np.uint64)])
        counts = np.fromiter(map(len, places), dtype=np.int64, count=len(places))
        return self.hashes[np.concatenate(places)] if places else self.hashes[:0], counts


def runs(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` consecutive words within each of several texts, and the text of each run."""
    text = np.repeat(np.arange(len(counts)), counts)
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = mix64(out * _STEP + words[k : m + k])
    within = text[:m] == text[n - 1 :]
    return out[within], text[:m][within]


def counted(hashes: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each group in ascending order, how often each occurs, and the offsets of the groups."""
    order = np.lexsort((hashes, group))
    hashes, group = hashes[order], group[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (group[1:] != group[:-1])
    heads = np.flatnonzero(first)
    return hashes[heads], np.diff(np.append(heads, len(hashes))), np.searchsorted(group[heads], np.arange(groups + 1))

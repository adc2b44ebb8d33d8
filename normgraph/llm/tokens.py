"""Encoding of texts with a public byte-level BPE vocabulary.

The distinct pre-tokens of a batch that are not yet known lie in one linked
list of symbols. A queue of merge ranks holds, per rank, the places where that
merge can happen; a three-level bitmap gives the least rank in use by
find-first-set. All places of a rank merge together, stale ones are skipped.
The cost is linear in the length of a pre-token, however long.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 30


class RankQueue:
    """Places by merge rank, ranks below 2^18; the least rank by find-first-set in a three-level bitmap."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = {}
        self.low, self.mid, self.top = [0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), 0

    def _mark(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def push(self, rank: int, place: int) -> None:
        got = self.buckets.get(rank)
        if got is None:
            self.buckets[rank] = [place]
            self._mark(rank)
        else:
            got.append(place)

    def push_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        heads = np.flatnonzero(np.diff(ranks, prepend=-1))
        values = places.tolist()
        for rank, lo, hi in zip(ranks[heads].tolist(), heads.tolist(), np.append(heads[1:], len(ranks)).tolist()):
            got = self.buckets.get(rank)
            if got is None:
                self.buckets[rank] = values[lo:hi]
                self._mark(rank)
            else:
                got.extend(values[lo:hi])

    def pop(self) -> tuple[int, list] | None:
        """Least rank in use and its places."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        a = (b << 6) + (self.mid[b] & -self.mid[b]).bit_length() - 1
        rank = (a << 6) + (self.low[a] & -self.low[a]).bit_length() - 1
        self.low[a] &= self.low[a] - 1
        if not self.low[a]:
            self.mid[b] &= self.mid[b] - 1
            if not self.mid[b]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class BytePairs:
    """A byte-level BPE vocabulary in tiktoken's form: token bytes in base64 and rank, by line."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines()) if t}
        self.find = regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {(ranks[t[:k]] << 20) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = pairs
        slots = 1 << (2 * len(pairs)).bit_length()
        self._shift = np.uint64(64 - (slots.bit_length() - 1))
        keys, values = np.full(slots, -1, dtype=np.int64), np.full(slots, _NONE, dtype=np.int32)
        every = np.fromiter(pairs, dtype=np.int64)
        home = self._home(every)
        for k, h, r in zip(every.tolist(), home.tolist(), pairs.values()):
            while keys[h] >= 0:
                h = (h + 1) & (slots - 1)
            keys[h], values[h] = k, r
        self._keys, self._values = keys, values

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of pairs of tokens, a large number where they don't merge."""
        keys = (left.astype(np.int64) << 20) | right
        at = self._home(keys)
        out = np.full(len(keys), _NONE, dtype=np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self._keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self._values[at[hit]]
            more = ~hit & (there >= 0)
            open_, at = open_[more], (at[more] + 1) & (len(self._keys) - 1)
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces, one after the other, and the offsets of each piece."""
        n_bytes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(n_bytes)
        n = int(ends[-1]) if len(ends) else 0
        tok = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        starts = ends - n_bytes
        nxt[ends[n_bytes > 0] - 1] = -1
        prv[starts[n_bytes > 0]] = -1
        now = np.full(n, _NONE, dtype=np.int32)  # rank of the pair that begins here
        at = np.flatnonzero(nxt >= 0)
        now[at] = self.rank(tok[at], tok[at + 1])
        alive = np.ones(n, dtype=bool)
        queue = RankQueue(self.size)
        at = np.flatnonzero(now < _NONE)
        queue.push_all(now[at], at)
        mt, mn, mp, mr, ma = (memoryview(x) for x in (tok, nxt, prv, now, alive.view(np.uint8)))
        pairs = self.pairs.get
        while (top := queue.pop()) is not None:
            rank, places = top
            if len(places) <= 40:
                if len(places) > 1:
                    places.sort()
                for p in places:
                    if mr[p] != rank:  # stale: merged or changed since
                        continue
                    q = mn[p]
                    after = mn[q]
                    mt[p], mn[p], ma[q], mr[q] = rank, after, 0, _NONE
                    if after >= 0:
                        mp[after] = p
                        r = pairs((rank << 20) | mt[after], _NONE)
                        mr[p] = r
                        if r < _NONE:
                            queue.push(r, p)
                    else:
                        mr[p] = _NONE
                    before = mp[p]
                    if before >= 0:
                        r = pairs((mt[before] << 20) | rank, _NONE)
                        mr[before] = r
                        if r < _NONE:
                            queue.push(r, before)
                continue
            p = np.array(places, dtype=np.int64)
            p = np.unique(p[now[p] == rank])
            if not len(p):
                continue
            # where places overlap, as in a run of one symbol, every other one merges, from the left
            chained = np.zeros(len(p), dtype=bool)
            chained[1:] = nxt[p[:-1]] == p[1:]
            if chained.any():
                index = np.arange(len(p))
                head = np.maximum.accumulate(np.where(chained, 0, index))
                p = p[(index - head) % 2 == 0]
            q = nxt[p]
            after = nxt[q]
            tok[p], nxt[p], alive[q], now[q], now[p] = rank, after, False, _NONE, _NONE
            has = after >= 0
            prv[after[has]] = p[has]
            before = prv[p]
            left = np.unique(np.concatenate([p[has], before[before >= 0]]))
            r = self.rank(tok[left], tok[nxt[left]])
            now[left] = r
            fits = r < _NONE
            queue.push_all(r[fits], left[fits])
        return tok[alive], np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])]


class Encoder:
    """Encodes batches of texts, with a bounded memory of pre-tokens and their ids."""

    def __init__(self, vocabulary: bytes, keep: int = 400_000):
        self.bpe, self.keep = BytePairs(vocabulary), keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text."""
        if len(self.known) > self.keep:
            self._forget()
        known, find = self.known, self.bpe.find
        seen, counts, new = [], [], []
        for t in texts:
            got = find(t) if t else ()
            counts.append(len(got))
            try:
                seen.append(np.fromiter(map(known.__getitem__, got), dtype=np.int32, count=len(got)))
            except KeyError:
                for w in got:
                    if w not in known:
                        known[w] = len(known)
                        new.append(w)
                seen.append(np.fromiter(map(known.__getitem__, got), dtype=np.int32, count=len(got)))
        if new:
            ids, ends = self.bpe.encode([w.encode("utf-8", "replace") for w in new])
            self.ends = np.concatenate([self.ends, ends[1:] + self.ends[-1]])
            self.ids = np.concatenate([self.ids, ids])
        words = np.concatenate(seen) if seen else np.empty(0, dtype=np.int32)
        n = self.ends[words + 1] - self.ends[words]
        done = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(self.ends[words] - done[:-1], n) + np.arange(done[-1])]
        return flat, done[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)]


def _encode(vocabulary, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary.value)
        for batch in batches:
            texts = batch["text"].to_pylist()
            lo = 0
            while lo < len(texts):  # a round holds about four million characters, or one text
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= 4_000_000):
                    size += len(texts[hi] or "")
                    hi += 1
                flat, ends = encode(texts[lo:hi])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch[key].slice(lo, hi - lo), ids], names=[key, "ids"])
                lo = hi

    return run


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row: its token ids, without special tokens, which are ordinary text here.

    A null or an empty text gives an empty list. Rows are kept as they are,
    repeated or not; a null key stays. Only the two named columns are read, and
    nothing is shuffled. The vocabulary file, below a megabyte, is read by the
    driver and broadcast.
    """
    with open(vocabulary, "rb") as f:
        content = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(documents[key].alias(key), documents[text].alias("text"))
    return rows.mapInArrow(_encode(content, key), f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{d}/documents.parquet"))

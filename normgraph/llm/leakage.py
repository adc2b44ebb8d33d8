"""Evaluation texts leaking into training text.

Passages of the evaluation items span a latent space: a distributed randomised
SVD of their TF-IDF matrix. Windows of items and documents are projected into it
and scaled to unit length there. Equal windows have equal vectors, whatever the
space keeps of them, so a run of words is looked for among windows of its own
length: a code of signs proposes, the cosine and the words decide, and no leak
is lost to the number of directions or to a threshold. Paraphrases are windows
of a high cosine whose longest common subsequence with the passage is long.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm.words import WORD
from normgraph.staging import stage

_BLOCK = 4096
_DIRECTIONS = 64  # of the latent space: one bit each of a code
_SHARD_WORDS = 100_000  # words of items searched for in one pass over the documents
_WORDS_AT_ONCE = 40_000
_SAME = 1 - 1e-4  # cosine of equal windows, less what rounding may take
_LONGEST = 50_000_000  # letters of the evaluation set, which the driver reads


@dataclass(frozen=True)
class Latent:
    """What the executors need of one shard of items. Word ids are rows of ``basis``; its last row, of zeros, is for words unknown."""

    vocabulary: dict[str, int]
    basis: np.ndarray  # (words + 1, directions), weighted by inverse document frequency
    codes: np.ndarray  # sorted codes of the windows of ``run`` words
    windows: np.ndarray  # (.., run) word ids, in order of the codes
    window_item: np.ndarray
    passages: np.ndarray  # (.., 2 * run) word ids, -1 beyond the end
    passage_item: np.ndarray
    run: int


def unit_vectors(basis: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Windows of word ids (rows of ``ids``) in the latent space, of unit length, or zero where nothing of them is in it.

    Words are added in their order, one column after the other, so that equal windows get equal bits.
    """
    out = np.zeros((len(ids), basis.shape[1]), dtype=np.float32)
    for column in ids.T:
        out += basis[column]
    length = np.sqrt(np.square(out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


def codes(vectors: np.ndarray) -> np.ndarray:
    """64-bit codes of the signs of vectors of at most 64 directions."""
    bits = np.packbits(vectors > 0, axis=1)
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, 8 - bits.shape[1])))).view(np.uint64)[:, 0]


def longest_common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _gram(weights, basis, dims: int):
    """Partial sums of A^T A B over passages of one partition, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, w = basis.value, weights.value
        out = np.zeros((dims, b.shape[1]))
        for batch in batches:
            for ids in (np.asarray(x.values) for x in batch["ids"]):
                row = ids % dims
                v = w[row]
                y = v @ b[row]
                y /= max(1e-12, np.square(np.bincount(row, v)).sum())  # passages of unit norm
                np.add.at(out, row, v[:, None] * y)
        blocks = range(0, dims, _BLOCK)
        yield pa.RecordBatch.from_pydict({"block": pa.array([lo // _BLOCK for lo in blocks], pa.int32()), "sums": pa.array([out[lo : lo + _BLOCK].tobytes() for lo in blocks], pa.binary())})

    return run


def _add_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=np.float64) for x in table["sums"].to_pylist())
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def randomised_svd(passages: DataFrame, weights: np.ndarray, k: int, rounds: int = 2, extra: int = 8, seed: int = 7) -> np.ndarray:
    """(dims, k) right singular vectors of the weighted passage matrix, its rows of unit norm.

    A random basis is carried through A^T A and orthonormalised ``rounds`` times;
    each product is a pass over the passages, summed by blocks of rows. The
    driver holds dims x (k + extra) numbers, whatever the number of passages.
    """
    sc = passages.sparkSession.sparkContext
    dims = len(weights)
    k = min(k, dims)
    width = min(dims, k + extra)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    shared = sc.broadcast(weights)

    def product(b: np.ndarray) -> np.ndarray:
        now = sc.broadcast(b)
        parts = passages.mapInArrow(_gram(shared, now, dims), "block int, sums binary").groupBy("block").applyInArrow(lambda t: _add_blocks(t), "block int, sums binary").collect()
        return np.concatenate([np.frombuffer(r.sums, dtype=np.float64).reshape(-1, width) for r in sorted(parts, key=lambda r: r.block)]) if parts else np.zeros((dims, width))

    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ product(basis))
    return basis @ turn[:, np.argsort(-values)[:k]]


def _windows(texts: Sequence[np.ndarray], size: int, step: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``size`` ids of each text, every ``step`` ids, and the text of each; the last ones are padded with -1 unless ``whole``."""
    out, owner = [], []
    for n, ids in enumerate(texts):
        if not whole:
            ids = np.append(ids, np.full(max(0, size - len(ids)) + (step - (len(ids) - size) % step) % step, -1))
        if len(ids) >= size:
            each = np.lib.stride_tricks.sliding_window_view(ids, size)[::step]
            out.append(each)
            owner.append(np.full(len(each), n))
    if not out:
        return np.empty((0, size), dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(out), np.concatenate(owner)


def fit(spark: SparkSession, texts: Sequence[Sequence[str]], owners: Sequence[int], run: int) -> Latent:
    """The latent space of the passages of some items, and their windows in it.

    ``texts`` are words of items, ``owners`` their numbers. Passages are of twice ``run`` words, every half ``run`` words.
    """
    vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    ids = [np.array([vocabulary[w] for w in t], dtype=np.int64) for t in texts]
    passages, passage_text = _windows(ids, 2 * run, run // 2, whole=False)
    rows = [p[p >= 0].tolist() for p in passages]
    df = np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=len(vocabulary))
    weights = np.log1p(len(rows) / df)
    slices = max(1, min(spark.sparkContext.defaultParallelism, len(rows) // 500))
    table = spark.createDataFrame(pa.table({"ids": pa.array(rows, pa.list_(pa.int32()))})).repartition(slices)
    basis = randomised_svd(table, weights, _DIRECTIONS, rounds=1) * weights[:, None]
    basis = np.vstack([basis, np.zeros(basis.shape[1])]).astype(np.float32)
    windows, window_text = _windows(ids, run, 1, whole=True)
    code = codes(unit_vectors(basis, windows))
    order = np.argsort(code, kind="stable")
    owner = np.asarray(owners, dtype=np.int32)
    long = (passages >= 0).sum(axis=1) >= run  # a shorter rest of an item says too little
    passages, passage_text = passages[long], passage_text[long]
    return Latent(vocabulary, basis, code[order], windows[order].astype(np.int32), owner[window_text[order]], passages.astype(np.int32), owner[passage_text], run)


def _runs_of(m: Latent, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, item): where in ``ids`` a window of an item stands. Windows with an unknown word are in no item."""
    known = np.append(0, np.cumsum(ids >= 0))
    at = np.flatnonzero(known[m.run :] - known[: -m.run] == m.run)
    places, items = [], []
    for lo in range(0, len(at), _WORDS_AT_ONCE):
        part = at[lo : lo + _WORDS_AT_ONCE]
        mine = ids[part[:, None] + np.arange(m.run)]
        vectors = unit_vectors(m.basis, mine)
        code = codes(vectors)
        left, right = np.searchsorted(m.codes, code, "left"), np.searchsorted(m.codes, code, "right")
        hit = np.flatnonzero(right > left)
        many = right[hit] - left[hit]
        mine_at = np.repeat(hit, many)
        theirs = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left[hit], many)
        for k in range(0, len(theirs), _WORDS_AT_ONCE):
            x, y = mine_at[k : k + _WORDS_AT_ONCE], theirs[k : k + _WORDS_AT_ONCE]
            a, b = vectors[x], unit_vectors(m.basis, m.windows[y])
            cosine = (a * b).sum(axis=1)
            near = (cosine >= _SAME) | (~a.any(axis=1) & ~b.any(axis=1))
            same = near & (mine[x] == m.windows[y]).all(axis=1)
            places.append(part[x[same]])
            items.append(m.window_item[y[same]])
    return (np.concatenate(places), np.concatenate(items)) if places else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32))


def _alike(m: Latent, passage_vectors: np.ndarray, ids: np.ndarray, least_cosine: float, least_share: float) -> tuple[np.ndarray, np.ndarray]:
    """(place, item) of windows of 2 * run words near a passage of an item, at least half of them words of items, that
    have ``least_share`` of the passage's words in order. Texts are 4 * run unknown words apart, so none meets another."""
    size = 2 * m.run
    padded = np.append(ids, np.full(size, -1))
    at = np.arange(0, len(ids), m.run)
    window = padded[at[:, None] + np.arange(size)]
    full = (window >= 0).sum(axis=1) >= m.run
    at, window = at[full], window[full]
    places, items = [], []
    for lo in range(0, len(at), 2048):
        cosine = unit_vectors(m.basis, window[lo : lo + 2048]) @ passage_vectors.T
        for x, y in zip(*(v.tolist() for v in np.nonzero(cosine >= least_cosine))):
            start = int(at[lo + x])
            around = padded[max(0, start - m.run) : start + size + m.run]
            passage = m.passages[y][m.passages[y] >= 0]
            if longest_common_subsequence(passage, around[around >= 0]) >= least_share * len(passage):
                places.append(start + int((window[lo + x] >= 0).argmax()))
                items.append(int(m.passage_item[y]))
    return np.array(places, dtype=np.int64), np.array(items, dtype=np.int32)


def _search(model: Broadcast, key: str, paraphrases: tuple[float, float] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Latent = model.value
        get, find = m.vocabulary.get, WORD.findall
        vectors = unit_vectors(m.basis, m.passages) if paraphrases else None
        gap = np.full(4 * m.run if paraphrases else 1, -1)  # unknown words after each text keep windows within texts
        for batch in batches:
            ids, starts, rows, size = [], [], [], 0
            docs, items, kinds = [], [], []

            def look(ids=ids, starts=starts, rows=rows, docs=docs, items=items, kinds=kinds):
                flat, begin = np.concatenate(ids), np.array(starts)
                found = [(*_runs_of(m, flat), "run")]
                if paraphrases:
                    found.append((*_alike(m, vectors, flat, *paraphrases), "paraphrase"))
                seen = set()
                for at, item, kind in found:
                    of = np.searchsorted(begin, at, "right") - 1
                    for d, i in sorted(set(zip(of.tolist(), item.tolist())) - seen):
                        seen.add((d, i))
                        docs.append(rows[d])
                        items.append(i)
                        kinds.append(kind)
                ids.clear(), starts.clear(), rows.clear()

            for d, text in enumerate(batch["text"].to_pylist()):
                words = find(text.lower()) if text else ()
                if len(words) < m.run:
                    continue
                ids += [np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words)), gap]
                starts.append(size)
                rows.append(d)
                size += len(words) + len(gap)
                if size > 10 * _WORDS_AT_ONCE:
                    look()
                    size = 0
            if ids:
                look()
            if docs:
                yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(docs)), pa.array(items, pa.int32()), pa.array(kinds)], names=[key, "item", "kind"])

    return run


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", run: int = 12, paraphrases: tuple[float, float] | None = None) -> DataFrame:
    """(key, item_key, kind): 'run' where the document holds ``run`` consecutive words of the item.

    With ``paraphrases``, a cosine and a share, also 'paraphrase' where it holds no run of the item but a window of
    2 * ``run`` words with at least that cosine to a passage of the item, around which at least that share of the
    passage's words stand in order.

    documents: (key, text); items: (item_key, text). Words are lower-cased runs
    of letters, marks and digits. Null and empty texts, and items of fewer than
    ``run`` words, match nothing. Each pair comes once, whatever the repeats;
    a null key is kept as null. Other columns are not read. Empty tables give an
    empty result.

    Items are searched for in shards of about 100,000 words, one pass over the documents
    each, so that what is broadcast is bounded: 64 directions for each word of a
    shard and its windows. The driver reads the evaluation set, of at most 50
    million letters, which is checked first.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    kind, item_kind = documents.select(key).schema[0].dataType.simpleString(), items.select(item_key).schema[0].dataType.simpleString()
    held = items.select(F.col(item_key).alias("id"), "text").filter("text is not null")
    letters = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if letters > _LONGEST:
        raise ValueError(f"the evaluation set has {letters} letters; search for it in parts")
    rows = held.collect()
    texts = [WORD.findall(r.text.lower()) for r in rows]
    shards: list[list[int]] = []
    full = _SHARD_WORDS
    for n, t in enumerate(texts):
        if len(t) >= run:
            if full >= _SHARD_WORDS:
                shards.append([])
                full = 0
            shards[-1].append(n)
            full += len(t)
    if not shards:
        return documents.select(F.col(key), F.lit(None).cast(item_kind).alias(item_key), F.lit("run").alias("kind")).limit(0)
    found = None
    for shard in shards:
        model = sc.broadcast(fit(spark, [texts[n] for n in shard], shard, run))
        part = documents.select(F.col(key).alias("key"), "text").mapInArrow(_search(model, "key", paraphrases), f"key {kind}, item int, kind string")
        found = part if found is None else found.unionByName(part)
    names = spark.createDataFrame([(n, rows[n].id) for shard in shards for n in shard], f"item int, id {item_kind}")
    pairs = found.join(F.broadcast(names), "item")
    return pairs.groupBy(F.col("key").alias(key), F.col("id").alias(item_key)).agg(F.max("kind").alias("kind"))


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", run: int = 12) -> DataFrame:
    """(key, item_key) of :func:`leaks` by runs of words."""
    return leaks(documents, items, key, item_key, run).select(key, item_key)


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share, answered = [], []
        for doc, item, answer in zip(*(batch[c].to_pylist() for c in ("text", "item_text", "answer"))):
            number: dict[str, int] = {}
            a, b = (np.array([number.setdefault(w, len(number)) for w in WORD.findall(t.lower())]) for t in (item, doc))
            share.append(longest_common_subsequence(a, b) / max(1, len(a)))
            words = " ".join(WORD.findall(answer.lower())) if answer else ""
            answered.append(f" {words} " in f" {' '.join(WORD.findall(doc.lower()))} " if words else None)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("key", "item", "kind")), pa.array(share, pa.float64()), pa.array(answered, pa.bool_())], names=["key", "item", "kind", "share", "answered"])


def leak_report(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", run: int = 12, paraphrases: tuple[float, float] = (0.75, 0.7), answer: str | None = None) -> DataFrame:
    """(key, item_key, kind, share, answered) of leaks and paraphrases, see :func:`leaks`.

    share: of the item's words that the document holds in order, by longest common subsequence, the largest over
    rows of one key. answered: whether the words of the item's column ``answer`` stand in the document one after the
    other; null without such a column or with a null or empty answer. Pairs with a null key are left out.
    """
    found = stage(leaks(documents, items, key, item_key, run, paraphrases), "leaks")
    pairs = found.select(F.col(key).alias("key"), F.col(item_key).alias("item"), "kind")
    texts = items.select(F.col(item_key).alias("item"), F.col("text").alias("item_text"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer")).filter("item_text is not null")
    both = pairs.join(texts, "item").join(documents.select(F.col(key).alias("key"), "text").filter("text is not null"), "key")
    types = dict(pairs.dtypes)
    each = both.select("key", "item", "kind", "text", "item_text", "answer").mapInArrow(_extent, f"key {types['key']}, item {types['item']}, kind string, share double, answered boolean")
    return each.groupBy(F.col("key").alias(key), F.col("item").alias(item_key), "kind").agg(F.max("share").alias("share"), F.max("answered").alias("answered"))


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(*_tables(spark, d))


def p8_extent(spark: SparkSession, d: str) -> DataFrame:
    """Leaks and paraphrases, and the share of each item's words that the document holds in order. The items have no answers to check."""
    return leak_report(*_tables(spark, d)).drop("answered")

"""Near-duplicate records with small edits.

Records become sets of hashed word runs, weighted by inverse document frequency
within fixed bounds. Improved consistent weighted samples of the sets, in bands,
propose pairs, and an exact check of the similarity follows. The bounds of the
weights turn the least plain similarity of a case into a least weighted one, for
which the collision curve gives the number of bands, whatever the frequencies
are. Records with the same set are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.llm.hashing import band_keys, bands_for, mix64, most_unequal
from normgraph.llm.words import WordHasher, counted, runs
from normgraph.staging import Staged, stage

_COUNTERS = 20  # the document-frequency sketch has 2^20 counters: 4 MB, whatever the input
_ROUND = 512
_SPREAD = 1.25  # the largest weight of a run over the least one
_ROWS = 3
_RECALL = 0.9999  # of a pair that is just enough alike, in the worst case of weights
_SKETCH = 4  # words of 32 two-bit samples, by which most of what the bands propose is dropped
_CARRIED = 2  # words of the sketch that go along with each band
_LOSS = 1e-5  # of pairs that are just enough alike, to the sketch
_CROWD = 1000  # members of a band that one task pairs with each other


def _shingles(fields: Sequence[str], n: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHasher()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2 * _ROUND):
                part = batch.slice(lo, 2 * _ROUND)
                texts = [t for row in zip(*(part[f].to_pylist() for f in fields)) for t in row]
                found, text = runs(*hashes(texts), n)
                keys, _, ends = counted(found, text // len(fields), part.num_rows)
                size = np.diff(ends)
                rows = np.flatnonzero(size >= least)
                keep = np.repeat(size >= least, size)
                offsets = pa.array(np.append(0, np.cumsum(size[rows])).astype(np.int32))
                sigs = [xxhash.xxh128_digest(keys[ends[r] : ends[r + 1]].tobytes()) for r in rows.tolist()]
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)[keep]))
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(rows)), pa.array(sigs, pa.binary()), lists], names=["id", "sig", "runs"])

    return run


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes.view(np.uint64)) >> np.uint64(64 - _COUNTERS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << _COUNTERS, dtype=np.int64)
    for batch in batches:
        total += np.bincount(_counter(np.asarray(batch["runs"].flatten())), minlength=len(total))
    used = np.flatnonzero(total)
    for lo in range(0, len(used), 100_000):
        part = used[lo : lo + 100_000]
        yield pa.RecordBatch.from_pydict({"counter": part, "n": total[part]})


def frequencies(sets: DataFrame) -> np.ndarray:
    """Rows of ``sets`` per counter of a sketch; runs that share a counter share their count."""
    df = np.zeros(1 << _COUNTERS, dtype=np.int64)
    counts = sets.select("runs").mapInArrow(_frequencies, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    df[counts["counter"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    return df


def bounded_weights(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies log(1 + n / df), scaled to 1 for a run of all ``n`` sets and _SPREAD for one of a single set."""
    idf = np.log1p(n / np.maximum(1, df))
    low, high = np.log(2), np.log1p(n)
    return (1 + (_SPREAD - 1) * np.clip((idf - low) / max(1e-9, high - low), 0, 1)).astype(np.float32)


def least_weighted(least: float) -> float:
    """The least weighted Jaccard similarity of sets of plain similarity ``least``: what they share weighs 1, the rest _SPREAD."""
    return least / (least + (1 - least) * _SPREAD)


def sample_values(keys: np.ndarray, weights: np.ndarray, hashes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ``hashes`` improved consistent weighted samplings, the values of weighted keys, of which a set's least
    is its sample, and the steps of the weights at which they are drawn."""
    log_w = np.log(weights).astype(np.float32)
    # two uniform numbers from the halves of a well-mixed key times an odd number per hash, three times
    base = [mix64(keys + np.uint64(j)) for j in range(1, 4)]
    odd = mix64(np.arange(1, 3 * hashes + 1, dtype=np.uint64)).reshape(hashes, 3) | np.uint64(1)
    unit = np.float32(2.0**-32)
    for k in range(hashes):
        u = [((b * o).view(np.uint32).astype(np.float32) + np.float32(0.5)) * unit for b, o in zip(base, odd[k])]
        r = -np.log(u[0][::2] * u[0][1::2])  # Gamma(2, 1)
        beta = u[2][1::2]
        t = np.floor(log_w / r + beta)
        yield np.log(-np.log(u[1][::2] * u[1][1::2])) - r * (t - beta + 1), t


def consistent_samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """Improved consistent weighted samples of segments of weighted keys: (segments, hashes) 64-bit samples.

    Two segments share a sample with the probability of their weighted Jaccard similarity. A key of the
    same weight is drawn alike wherever it stands, so what repeats among the segments is drawn once.
    """
    out = np.empty((len(starts), hashes), dtype=np.uint64)
    weights = weights.astype(np.float32)
    _, first, place = np.unique(keys ^ mix64(weights.view(np.uint32)), return_index=True, return_inverse=True)
    keys, number = keys[first], np.arange(len(first))
    for k, (value, step) in enumerate(sample_values(keys, weights[first], hashes)):
        # the value's order in the upper half of an integer, the key's number in the lower: one minimum gives both
        bits = value.view(np.int32)
        ordered = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) << 32 | number
        at = np.minimum.reduceat(ordered[place], starts) & 0xFFFFFFFF
        out[:, k] = mix64(keys[at] + step[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _sampled(df, n: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROUND):
                part = batch.slice(lo, _ROUND)
                lists = part["runs"]
                keys = np.asarray(lists.flatten())
                starts = (np.asarray(lists.offsets)[:-1] - np.asarray(lists.offsets)[0]).astype(np.int64)
                weights = bounded_weights(df.value[_counter(keys)], n)
                samples = consistent_samples(keys.view(np.uint64), weights, starts, bands * _ROWS)
                found = pa.ListArray.from_arrays(pa.array(np.arange(len(samples) + 1, dtype=np.int32) * bands), pa.array(band_keys(samples, _ROWS).reshape(-1)))
                bits = (samples[:, : 32 * _SKETCH] & np.uint64(3)) << (np.uint64(2) * (np.arange(32 * _SKETCH, dtype=np.uint64) % np.uint64(32)))
                words = bits.reshape(len(samples), _SKETCH, 32).sum(axis=2, dtype=np.uint64).view(np.int64)
                size = np.diff(np.append(starts, len(keys))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["cid"], found, pa.array(size), *map(pa.array, words.T)], names=["cid", "bands", "size", *_sketch()])

    return run


def _sketch(suffix: str = "") -> list[str]:
    return [f"s{k}{suffix}" for k in range(_SKETCH)]


def _allowed(words: int, similarity: float, least: float) -> Column:
    """Whether the sizes and the first ``words`` words of two sketches (columns with _a and _b) allow a weighted ``similarity`` and a plain one of ``least``."""
    unequal = F.lit(0)
    for c in _sketch()[:words]:
        x = F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(least) - 1e-6
    return fits & (unequal <= most_unequal(similarity, 32 * words, _LOSS))


def likely_pairs(pairs: DataFrame, sampled: DataFrame, similarity: float, least: float) -> DataFrame:
    """Those of the pairs whose sizes and whole sketches allow a weighted ``similarity`` and a plain one of ``least``."""
    for x in "ab":
        pairs = pairs.join(sampled.select(F.col("cid").alias(f"cid_{x}"), F.col("size").alias(f"size_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in _sketch()]), f"cid_{x}")
    return pairs.filter(_allowed(_SKETCH, similarity, least)).select("cid_a", "cid_b")


def banded_pairs(bands: DataFrame, crowd: int = _CROWD, fits: Column | None = None) -> DataFrame:
    """(cid_a, cid_b), cid_a < cid_b, once each: pairs of (cid, band, ..) that share a band, and for which the condition
    ``fits`` on their other columns, with _a and _b after their names, holds. It is checked where pairs are made.

    A band of more than ``crowd`` members, found by a map-side count, is split: each task pairs ``crowd`` of them with all.
    """
    side = lambda df, x: df.withColumnsRenamed({c: f"{c}_{x}" for c in bands.columns if c != "band"})
    pair = (F.col("cid_a") < F.col("cid_b")) & (F.lit(True) if fits is None else fits)
    crowds = Staged(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd), "crowds", n=F.count(F.lit(1)))
    if not crowds.seen["n"]:
        return side(bands, "a").join(side(bands, "b"), "band").filter(pair).select("cid_a", "cid_b").distinct()
    few = bands.join(crowds.df, "band", "left_anti")
    out = side(few, "a").join(side(few, "b"), "band").filter(pair).select("cid_a", "cid_b")
    many, parts = bands.join(crowds.df, "band"), F.ceil(F.col("n") / crowd).cast("int")
    left = side(many.withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int")).drop("n"), "a")
    right = side(many.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n"), "b")
    out = out.unionByName(left.join(right, ["band", "part"]).filter(pair).select("cid_a", "cid_b"))
    return out.distinct()


def _alike(least: float, df, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4 * _ROUND):
                part = batch.slice(lo, 4 * _ROUND)
                n = part.num_rows
                pair, keys = [], []
                for x in "ab":
                    lists = part[f"runs_{x}"]
                    pair.append(np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets))))
                    keys.append(np.asarray(lists.flatten()))
                pair, keys = np.concatenate(pair), np.concatenate(keys)
                order = np.lexsort((keys, pair))
                pair, keys = pair[order], keys[order]
                both = np.flatnonzero((pair[1:] == pair[:-1]) & (keys[1:] == keys[:-1]))
                shared = np.bincount(pair[both], minlength=n)
                size = np.bincount(pair, minlength=n)
                plain = shared / (size - shared)
                keep = pa.array(plain >= least)
                weights = bounded_weights(df.value[_counter(keys)], total)
                common = np.bincount(pair[both], weights[both], minlength=n)
                weighted = common / (np.bincount(pair, weights, minlength=n) - common)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (part["sig_a"], part["sig_b"], pa.array(plain), pa.array(weighted))], names=["sig_a", "sig_b", "alike", "weighted"])

    return run


def near_duplicates(records: DataFrame, key: str, fields: Sequence[str], n: int = 3, least: float = 0.6, least_runs: int = 15) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records whose run sets are at least ``least`` alike.

    members: (id, sig), each record with its class of equal sets; links: (sig_a,
    sig_b, alike, weighted), each pair of classes once, with its plain and weighted similarity. A record's set is of all runs
    of ``n`` words within each of the text ``fields``. Null and empty texts have
    no runs; records with fewer than ``least_runs`` runs are in neither result.
    Repeated rows count once; rows of one id with different texts are members of
    each class. Only the named columns are read. An empty input gives empty results.

    A pair that is just enough alike shares a band with a probability of at least
    0.9999, whatever the frequencies of its runs, and is lost to the sketch with one of
    at most 2e-5; more alike ones are rather found.
    """
    spark = records.sparkSession
    rows_in = records.select(F.col(key).cast("long").alias("id"), *fields).filter("id is not null")
    each = stage(rows_in.mapInArrow(_shingles(list(fields), n, least_runs), "id long, sig binary, runs array<long>"), "runs")
    members = each.select("id", "sig").distinct()
    # within the operator a class goes by a number, half as long as its signature and better to compress
    classes = Staged(each.groupBy("sig").agg(F.min("runs").alias("runs")).withColumn("cid", F.monotonically_increasing_id()), "classes", n=F.count(F.lit(1)))
    sets, total = classes.df, classes.seen["n"]
    df = spark.sparkContext.broadcast(frequencies(sets).astype(np.int32))
    n_bands = max(bands_for(least_weighted(least), _ROWS, _RECALL), -(-32 * _SKETCH // _ROWS))
    columns = ", ".join(["cid long", "bands array<long>", "size int", *[f"{c} long" for c in _sketch()]])
    sampled = Staged(sets.select("cid", "runs").mapInArrow(_sampled(df, total, n_bands), columns), "sampled")
    # half of the sketch goes along with the bands, so that of the many pairs little alike few leave the join
    some = sampled.df.select("cid", "size", *_sketch()[:_CARRIED], F.explode("bands").alias("band"))
    pairs = banded_pairs(some, fits=_allowed(_CARRIED, least_weighted(least), least))
    pairs = likely_pairs(pairs, sampled.df, least_weighted(least), least)
    side = lambda x: sets.select(*[F.col(c).alias(f"{c}_{x}") for c in ("cid", "sig", "runs")])
    links = pairs.join(side("a"), "cid_a").join(side("b"), "cid_b").mapInArrow(_alike(least, df, total), "sig_a binary, sig_b binary, alike double, weighted double")
    links = stage(links, "links")
    sampled.drop()
    classes.drop()
    return members, links


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group, n_links): connected groups of classes, named by their smallest id, and the number of
    other classes each record's class is linked with.

    Labels spread by minimum over links, each round also jumping to the label's label, so that the
    rounds are the logarithm of the length of a chain.
    """
    arcs = stage(links.select(F.col("sig_a").alias("x"), F.col("sig_b").alias("y")).unionByName(links.select(F.col("sig_b").alias("x"), F.col("sig_a").alias("y"))), "arcs")
    label = stage(members.select("sig").distinct().select("sig", F.col("sig").alias("root")), "label")
    while True:
        near = arcs.join(label.withColumnRenamed("sig", "y").withColumnRenamed("root", "r"), "y").groupBy("x").agg(F.min("r").alias("near"))
        step = label.join(near, label["sig"] == near["x"], "left").select("sig", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = step.join(step.select(F.col("sig").alias("root"), F.col("root").alias("further")), "root", "left").select("sig", "old", F.coalesce("further", "root").alias("root"))
        new = stage(jump, "label")
        changed = new.filter("old <> root").limit(1).count()
        label = new.drop("old")
        if not changed:
            break
    degree = arcs.groupBy(F.col("x").alias("sig")).agg(F.count("*").alias("n_links"))
    named = members.join(label, "sig").join(degree, "sig", "left")
    names = named.groupBy("root").agg(F.min("id").alias("group"))
    return named.join(names, "root").groupBy("id").agg(F.min("group").alias("group"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))


def _clauses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(spark.read.parquet(f"{d}/clause_changes.parquet"), "change_id", ["base_text", "target_text"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of clause changes with largely the same text; TESTDATA.md asks for each."""
    members, links = _clauses(spark, d)
    members = stage(members, "members")
    a, b = members.select(F.col("id").alias("x"), F.col("sig").alias("sig_a")), members.select(F.col("id").alias("y"), F.col("sig").alias("sig_b"))
    across = links.join(a, "sig_a").join(b, "sig_b").select("x", "y")
    within = a.join(b, F.col("sig_a") == F.col("sig_b")).select("x", "y")
    pairs = across.unionByName(within).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("change_a"), F.greatest("x", "y").alias("change_b")).distinct()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    members, links = _clauses(spark, d)
    return groups(stage(members, "members"), links).select(F.col("id").alias("change_id"), F.col("group").alias("class_id"), "n_links")

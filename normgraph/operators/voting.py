"""Patterns in recorded votes. Votes are rows (vote, topic, voter, position), position for, against, abstain or absent."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normgraph.staging import Staged, buckets_for

_JOINED = 4  # pairs within votes and positions, per row of votes, up to which they are joined and shuffled
_PER_TASK = 1 << 28  # of such pairs that are counted in one task otherwise
_PER_BLOCK = 4_000_000  # rows of votes of a block of voters
_SHORT = 1 << 15  # voters of a block whose places fit two bytes
_OUT = 50_000
_LATE = 4_000_000  # pairs held until they are put in order of the voter who voted less


def voter_profiles(votes: DataFrame) -> DataFrame:
    """Positions counted per voter."""
    of = lambda p: F.count_if(F.col("position") == p)
    return votes.groupBy("voter").agg(F.count(F.lit(1)).alias("n_votes"), of("for").alias("n_for"), of("against").alias("n_against"), of("abstain").alias("n_abstain"), of("absent").alias("n_absent"))


def coalitions(votes: DataFrame, threshold: float = 0.8, least: int = 5) -> DataFrame:
    """(voter_a, voter_b, n_shared, n_votes, rate): pairs that took the same position in a share of at
    least ``threshold`` of the votes of the one who voted less, who has at least ``least``.

    A voter's last position counts where a vote holds several (the largest in text order). Few pairs come
    from a join within vote and position, counted map-side. Where they are many times the rows, they are not
    shuffled: voters are put in blocks, and each pair of blocks is counted whole by one task, from the lists
    of members of the positions that both share. Its rows come by the voter who voted less and by n_shared.
    """
    v = Staged(votes.groupBy("vote", "voter").agg(F.max("position").alias("position"), F.count(F.lit(1)).alias("n")), "votes")
    # a voter of fewer votes is in no pair
    total = Staged(v.df.filter("voter is not null").groupBy("voter").agg(F.sum("n").alias("n_votes")).filter(F.col("n_votes") >= least), "voters")
    taken = v.df.filter("vote is not null and position is not null").select("vote", "position", "voter")
    size = taken.groupBy("vote", "position").agg(F.count(F.lit(1)).cast("double").alias("n"))
    n_rows, n_pairs = size.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.expr("n * (n - 1) / 2")), F.lit(0.0))).first()
    if n_pairs <= _JOINED * n_rows:
        shared = _joined(taken, total.df)
    else:
        shared = _counted(taken, total.df, max(math.ceil(math.sqrt(2 * n_pairs / _PER_TASK)), buckets_for(int(n_rows), _PER_BLOCK)), threshold)
        v.drop()
    rate = F.col("n_shared") / F.col("n_votes")
    return shared.withColumn("rate", rate).filter(F.col("rate") >= threshold).select("voter_a", "voter_b", "n_shared", "n_votes", "rate")


def _joined(taken: DataFrame, total: DataFrame) -> DataFrame:
    """(voter_a, voter_b, n_shared, n_votes) of all pairs that share a position (vote, position, voter), by a join."""
    a, b = taken.withColumnRenamed("voter", "voter_a"), taken.withColumnRenamed("voter", "voter_b")
    shared = a.join(b, ["vote", "position"]).filter("voter_a < voter_b").groupBy("voter_a", "voter_b").agg(F.count(F.lit(1)).alias("n_shared"))
    ta, tb = total.select(F.col("voter").alias("voter_a"), F.col("n_votes").alias("na")), total.select(F.col("voter").alias("voter_b"), F.col("n_votes").alias("nb"))
    return shared.join(ta, "voter_a").join(tb, "voter_b").select("voter_a", "voter_b", "n_shared", F.least("na", "nb").alias("n_votes"))


def _counted(taken: DataFrame, total: DataFrame, blocks: int, threshold: float) -> DataFrame:
    """As :func:`_joined`, of those pairs only whose share is at least ``threshold``; voters in so many blocks."""
    block = F.pmod(F.xxhash64("voter"), F.lit(blocks)).cast("int")
    voters = Staged(total.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("voter", "n_votes"))).alias("of")), "blocks", most=F.max(F.size("of")))
    place = "smallint" if (voters.seen["most"] or 0) <= _SHORT else "int"
    places = voters.df.select("block", F.posexplode("of").alias("at", "of")).select("block", F.col("at").cast(place).alias("at"), "of.voter")
    lists = Staged(taken.join(places, "voter").groupBy("vote", "position", "block").agg(F.collect_list("at").alias("at")), "lists")
    pair = lambda lo, hi: (hi.cast("long") * (hi + 1) / 2).cast("long") + lo
    none = F.lit(None).cast(f"array<{place}>")
    side = lambda x: lists.df.select("vote", "position", F.col("block").alias(f"block_{x}"), F.col("at").alias(x))
    met = side("a").join(side("b"), ["vote", "position"]).filter("block_a <= block_b")
    met = met.select(pair(F.col("block_a"), F.col("block_b")).alias("pair"), F.lit(2).alias("kind"), (F.col("block_a") == F.col("block_b")).alias("twin"), "a", "b", F.lit(None).cast(voters.df.schema["of"].dataType).alias("of"))
    other = voters.df.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    head = lambda kind, lo, hi: other.filter(F.col(lo) <= F.col(hi)).select(pair(F.col(lo), F.col(hi)).alias("pair"), F.lit(kind).alias("kind"), (F.col("block") == F.col("other")).alias("twin"), none.alias("a"), none.alias("b"), "of")
    sent = head(0, "block", "other").unionByName(head(1, "other", "block")).unionByName(met)
    parts = min(blocks * (blocks + 1) // 2, 20_000)
    sent = sent.repartitionById(parts, F.pmod("pair", F.lit(parts)).cast("int")).sortWithinPartitions("pair", "kind")
    voter = taken.schema["voter"].dataType
    out = T.StructType([T.StructField("x", voter), T.StructField("y", voter), T.StructField("n_shared", T.LongType()), T.StructField("n_votes", T.LongType())])
    found = sent.mapInArrow(_count_blocks(threshold), out)
    return found.select(F.least("x", "y").alias("voter_a"), F.greatest("x", "y").alias("voter_b"), "n_shared", "n_votes")


def _needed(n: np.ndarray, threshold: float) -> np.ndarray:
    """The least number of shared positions, one at least, whose share of ``n`` is at least ``threshold``; it does not fall as n grows."""
    k = np.maximum(np.ceil(n * threshold), 1).astype(np.int64)
    k = np.where((k > 1) & ((k - 1) / n >= threshold), k - 1, k)
    return np.where(k / n >= threshold, k, k + 1)


def _sorted(first: np.ndarray, k: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of whole numbers, not negative, in the order of the three in turn; by one sort of one number where they fit it."""
    most, u, v = (int(x.max(initial=0)).bit_length() for x in (first, k, other))
    if most + u + v > 63:
        order = np.lexsort((other, k, first))
        return first[order], k[order], other[order]
    key = (first.astype(np.int64) << u | k) << v | other
    key.sort()
    return key >> u + v, key >> v & (1 << u) - 1, key & (1 << v) - 1


def _count_blocks(threshold: float):
    """Rows of a pair of blocks follow each other: the voters of either (kind 0 and 1), then the members, in the blocks, of each position.

    Pairs come out by the voter who voted less, by n_shared, then by the other, in parts of ``_LATE`` pairs: values
    that repeat follow each other, so files of them are small.
    """

    def pairs(voters: list[pa.StructArray], twin: bool, a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        (names_a, n_a), (names_b, n_b) = [(of.field("voter"), np.asarray(of.field("n_votes"))) for of in voters]
        need_a, need_b, width = _needed(n_a, threshold), _needed(n_b, threshold), len(n_b)
        least = need_b.min()
        rank = np.argsort(np.argsort(n_b, kind="stable"))  # within a block, pairs are those of a voter who voted less, or as much, and came first
        small_a, small_b, small_k = (np.min_scalar_type(most) for most in (len(n_a), width, len(a)))

        def rows(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(k), _OUT):
                x, y = i[at : at + _OUT], j[at : at + _OUT]
                yield pa.RecordBatch.from_arrays([names_a.take(pa.array(x)), names_b.take(pa.array(y)), pa.array(k[at : at + _OUT].astype(np.int64)), pa.array(np.minimum(n_a[x], n_b[y]))], names=["x", "y", "n_shared", "n_votes"])

        members = np.concatenate(a)
        order = np.argsort(members, kind="stable")
        place, row = members[order], np.repeat(np.arange(len(a)), [len(m) for m in a])[order]
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        left, right, shared, held = [], [], [], 0
        late, n_late = [], 0  # of pairs whose second voter voted less
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(place)]):
            at = place[lo]
            hits = np.concatenate([b[r] for r in row[lo:hi].tolist()])
            if len(hits) * 16 < width:
                met, k = np.unique(hits, return_counts=True)
            else:
                k = np.bincount(hits, minlength=width)
                met = np.flatnonzero(k >= min(need_a[at], least))
                k = k[met]
            keep = k >= np.minimum(need_b[met], need_a[at])
            if twin:
                keep &= rank[met] > rank[at]
            met = met[keep]
            left.append(np.full(len(met), at, small_a))
            right.append(met.astype(small_b))
            shared.append(k[keep].astype(small_k))
            held += len(met)
            if held >= _OUT or hi == len(place):
                i, j, k = np.concatenate(left), np.concatenate(right), np.concatenate(shared)
                less = n_b[j] < n_a[i]
                x, n, y = _sorted(i[~less], k[~less], j[~less])
                yield from rows(x, y, n)
                late.append((j[less], k[less], i[less]))
                n_late += len(late[-1][0])
                left, right, shared, held = [], [], [], 0
                if n_late >= _LATE or hi == len(place):
                    y, n, x = _sorted(*(np.concatenate(of) for of in zip(*late)))
                    yield from rows(x, y, n)
                    late, n_late = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, voters, twin, a, b = None, [], False, [], []
        for batch in batches:
            kinds, twins = batch["kind"].to_pylist(), batch["twin"].to_pylist()
            for i, p in enumerate(batch["pair"].to_pylist()):
                if p != now:
                    if a:
                        yield from pairs(voters, twin, a, b)
                    now, voters, twin, a, b = p, [], twins[i], [], []
                if kinds[i] == 2:
                    a.append(batch["a"][i].values.to_numpy())
                    b.append(batch["b"][i].values.to_numpy().astype(np.int64))
                else:
                    voters.append(batch["of"][i].values)
        if a:
            yield from pairs(voters, twin, a, b)

    return run


def _by_topic(votes: DataFrame) -> DataFrame:
    return votes.groupBy("voter", "topic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("positions"), F.count_if(F.col("position") == "against").alias("against"))


def swing_voters(votes: DataFrame, above: float = 0.2) -> DataFrame:
    """(voter, n_topics, n_varied, score): the share of topics with several votes in which the position varied."""
    t = _by_topic(votes).filter("n >= 2").groupBy("voter").agg(F.count(F.lit(1)).alias("n_topics"), F.count_if(F.col("positions") > 1).alias("n_varied"))
    return t.withColumn("score", F.col("n_varied") / F.col("n_topics")).filter(F.col("score") > above)


def consistent_opponents(votes: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """(voter, topic, n, against, rate) where at least ``share`` of at least ``least`` votes on a topic were against."""
    t = _by_topic(votes).withColumn("rate", F.col("against") / F.col("n"))
    return t.filter((F.col("n") >= least) & (F.col("rate") >= share)).select("voter", "topic", "n", "against", "rate")


def topic_clusters(votes: DataFrame, close: float = 0.2) -> DataFrame:
    """(topic, n_votes, n_adopted, n_rejected, n_close) over votes; a vote is close if for and against differ by less than ``close`` of their sum."""
    per = votes.groupBy("vote", "topic").agg(F.count_if(F.col("position") == "for").alias("f"), F.count_if(F.col("position") == "against").alias("a"))
    total = F.col("f") + F.col("a")
    return per.groupBy("topic").agg(F.count(F.lit(1)).alias("n_votes"), F.count_if(F.col("f") > F.col("a")).alias("n_adopted"), F.count_if(F.col("f") < F.col("a")).alias("n_rejected"), F.count_if((total > 0) & (F.abs(F.col("f") - F.col("a")) < close * total)).alias("n_close"))

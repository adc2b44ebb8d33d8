"""Parent–child links to full hierarchies: path, depth, root, nested-set ranges, cycles.

Subtree sizes are summed upward, then sibling ranges of preorder numbers are
allotted by prefix sums and summed downward. Both passes double the distance
they reach each round, so their number is the logarithm of the depth. Nodes
that no round resolves hang on a loop. Roots, depths, ancestors and descendants
are read off the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normgraph.staging import Staged, buckets_for, hot_split_join, stage

_CHUNK_ROWS = 200_000  # siblings, or preorder numbers, that one task sums up


class _Pointing:
    """How many of the rows (.., anc) point at each anc, and sums over them, as a written table."""

    def __init__(self, rows: DataFrame, hot_rows: int, *sums):
        counted = rows.groupBy("anc").agg(F.count("*").alias("n_pointing"), *sums)
        self.table = Staged(counted, "pointing", hot=F.count_if(F.col("n_pointing") > hot_rows))
        self.hot_rows = hot_rows
        self.n_hot = self.table.seen["hot"]

    def follow(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """Join ``rows.anc`` to ``known.anc``."""
        known = known.join(self.table.df.select("anc", "n_pointing"), "anc")
        return hot_split_join(rows, known, ["anc"], "n_pointing", self.hot_rows, n_hot=self.n_hot)


def nested_sets(nodes: DataFrame, with_path: bool = False, sep: str = "/") -> DataFrame:
    """Hierarchy of ``nodes`` (id, parent), ids unique and not null.

    Returns id, parent (null for a root), root, depth, n_descendants, pre and
    last: the preorder range of the node and its subtree, so that y is a
    descendant of x if x.pre < y.pre <= x.last. Siblings, and roots, are in
    order of a hash chunk, then of id. ``with_path`` adds path, the ids from the
    root joined by ``sep``. A null parent, or one that is no id, makes a root; a
    node that is its own parent is a loop. Nodes in or below a loop get root
    'cycle', depth, n_descendants, pre and last -1 and a null path. An empty
    input gives an empty result.

    Each round is two written tables. Ancestors that more than a thousandth of
    the nodes point at are joined by broadcast (at most 1,000 of them), sums
    combine before the shuffle, and prefix sums run in chunks.
    """
    nodes = Staged(nodes.select("id", "parent"), "nodes", n=F.count(F.lit(1)))
    total = nodes.seen["n"]
    hot_rows = max(1000, total // 1000)
    linked = nodes.df.select("id", F.col("parent").alias("anc")).filter("anc is not null")
    there = nodes.df.select(F.col("id").alias("anc"))
    parents = _Pointing(linked, hot_rows).follow(linked, there).select("id", F.col("anc").alias("parent"))
    # anc: the node's ancestor at distance 2^k, null beyond the root; size: its descendants nearer than 2^k, and itself
    path = [F.col("id").alias("path")] if with_path else []
    first = nodes.df.select("id").join(parents, "id", "left").select("id", "parent", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size"), *path)
    still_open = F.count_if(F.col("anc").isNotNull())
    state = Staged(first, "upward", open=still_open)
    links = state.df.select("id", "parent")
    unresolved, jumps = -1, []
    # none is between this reach and the one before: what is left hangs on a loop
    while state.seen["open"] not in (0, unresolved):
        unresolved = state.seen["open"]
        now = state.df
        open_rows = now.filter("anc is not null").select("id", "anc", "size", *(["path"] if with_path else []))
        pointing = _Pointing(open_rows, hot_rows, F.sum("size").alias("gain"))
        known = now.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), *([F.col("path").alias("path2")] if with_path else []))
        paths = [F.concat_ws(sep, "path2", "path").alias("path")] if with_path else []
        step = pointing.follow(open_rows, known).select("id", F.col("anc2").alias("anc"), "size", *paths)
        done = now.filter("anc is null").select(*step.columns)
        gain = pointing.table.df.select(F.col("anc").alias("id"), "gain")
        after = done.unionByName(step).join(gain, "id", "left").withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0))).drop("gain")
        jumps.append((state, pointing))
        state = Staged(after, "upward", open=still_open)
    loops = state.df.filter("anc is not null").select("id").join(links, "id")
    tree = state.df.filter("anc is null").select("id", "size", *(["path"] if with_path else [])).join(links, "id")

    # downward: a node's offset from its parent is one and the sizes of the siblings before it
    sib = tree.select("id", "parent", "size", F.pmod(F.xxhash64("id"), F.lit(buckets_for(total, _CHUNK_ROWS, 64))).alias("chunk"))
    before = F.sum("size").over(Window.partitionBy("parent", "chunk").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    inner = sib.select("id", "parent", "chunk", F.coalesce(before, F.lit(0)).alias("within"))
    heads = sib.groupBy("parent", "chunk").agg(F.sum("size").alias("chunk_size"))
    ahead = F.sum("chunk_size").over(Window.partitionBy("parent").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("parent", "chunk", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    none = {"p": F.coalesce("parent", F.lit("")), "r": F.col("parent").isNull()}
    a, b = inner.withColumns(none), heads.withColumns(none).drop("parent")
    offsets = a.join(b, ["p", "r", "chunk"]).select("id", (F.col("within") + F.col("ahead") + F.when(F.col("r"), 0).otherwise(1)).alias("pre"))
    down = Staged(offsets, "downward")
    for at, pointing in jumps:
        jump = at.df.filter("anc is not null").select("id", "anc")
        gain = pointing.follow(jump, down.df.select(F.col("id").alias("anc"), F.col("pre").alias("gain"))).select("id", "gain")
        new = Staged(down.df.join(gain, "id", "left").select("id", (F.col("pre") + F.coalesce("gain", F.lit(0))).alias("pre")), "downward")
        down.drop()
        pointing.table.drop()
        down = new
    ranges = stage(tree.join(down.df, "id").withColumn("last", F.col("pre") + F.col("size") - 1), "ranges")
    out = _levels(ranges).withColumn("n_descendants", F.col("last") - F.col("pre"))
    minus = [F.lit(-1).cast("long").alias(c) for c in ("depth", "n_descendants", "pre", "last")]
    looped = loops.select("id", "parent", F.lit("cycle").alias("root"), *minus, *([F.lit(None).cast("string").alias("path")] if with_path else []))
    return out.select(*looped.columns).unionByName(looped)


def _levels(ranges: DataFrame) -> DataFrame:
    """Preorder ranges (id, parent, pre, last, ..), numbered from 0 without gaps, with root and depth.

    As many nodes begin before a node as its number says; its ancestors are those of them that have not
    ended before it. Its root is the last one that began. Both are running values over chunks of numbers.
    """
    chunk = F.floor(F.col("at") / _CHUNK_ROWS).alias("chunk")
    ended = ranges.groupBy((F.col("last") + 1).alias("at")).agg(F.count(F.lit(1)).alias("ended"))
    rows = ranges.withColumnRenamed("pre", "at").join(ended, "at", "left").select("*", chunk)
    top = F.when(F.col("parent").isNull(), F.col("id"))
    # what ends after the last number of all is of no interest, so each end meets a node
    per = rows.groupBy("chunk").agg(F.coalesce(F.sum("ended"), F.lit(0)).alias("n"), F.max_by(top, F.when(top.isNotNull(), F.col("at"))).alias("top"))
    order = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    carry = per.select("chunk", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("carried"), F.last("top", ignorenulls=True).over(order).alias("before"))
    w = Window.partitionBy("chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("gone", F.coalesce(F.sum("ended").over(w), F.lit(0))).withColumn("own", F.last(top, ignorenulls=True).over(w)).join(carry, "chunk")
    run = run.withColumn("depth", F.col("at") - F.col("gone") - F.col("carried")).withColumn("root", F.coalesce("own", "before"))
    return run.drop("chunk", "ended", "gone", "own", "carried", "before").withColumnRenamed("at", "pre")


def descendants(tree: DataFrame, of: DataFrame | None = None, width: int = 4096) -> DataFrame:
    """Pairs (id, descendant) of the nodes ``of`` (id), by default of all, by their nested-set ranges.

    Ranges and nodes meet in buckets of ``width`` preorder numbers, so that a tree of any size spreads over
    all tasks; a range has a row for each bucket it touches. Read the other way round, these are the
    ancestors. Nodes on loops have no descendants here.
    """
    tops = tree.filter("last > pre")
    if of is not None:
        tops = tops.join(of.select("id").distinct(), "id", "left_semi")
    b = lambda c: F.floor(c / width)
    tops = tops.select(F.col("id").alias("top"), F.col("pre").alias("lo"), "last", F.explode(F.sequence(b(F.col("pre") + 1), b(F.col("last")))).alias("bucket"))
    below = tree.filter("pre >= 0").select("id", "pre", b(F.col("pre")).alias("bucket"))
    return tops.join(below, "bucket").filter("pre > lo and pre <= last").select(F.col("top").alias("id"), F.col("id").alias("descendant"))


def institution_nodes(rows: DataFrame) -> DataFrame:
    """(id, parent) of the latest row per institution, trimmed and in upper case.

    Rows with a null or blank id name no institution. Rows of the same time tie
    to the largest parent.
    """
    key = lambda c: F.upper(F.trim(c))
    rows = rows.select(key("id").alias("id"), F.nullif(key("parent"), F.lit("")).alias("parent"), "recorded_at").filter("id <> ''")
    return rows.groupBy("id").agg(F.max(F.struct("recorded_at", "parent")).alias("last")).select("id", F.col("last.parent").alias("parent"))


def _institutions(spark: SparkSession, d: str, with_path: bool) -> DataFrame:
    return nested_sets(institution_nodes(spark.read.parquet(f"{d}/institutions.parquet")), with_path)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and number of descendants of every institution, read off its preorder range."""
    return _institutions(spark, d, False).select(F.col("id").alias("institution_id"), F.col("root").alias("root_id"), "depth", "n_descendants")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every institution with each of its descendants."""
    tree = stage(_institutions(spark, d, False).select("id", "pre", "last"), "tree")
    return descendants(tree).select(F.col("id").alias("institution_id"), F.col("descendant").alias("descendant_id"))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root of every institution that has one."""
    return _institutions(spark, d, True).filter("depth >= 0").select(F.col("id").alias("institution_id"), "path")

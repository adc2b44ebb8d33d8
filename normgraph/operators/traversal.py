"""Walks over a graph of triples: impact, paths, subgraphs, containment, components and loops.

Every walk keeps a frontier and a set of what it has seen, and writes both each
round, so that its plan stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normgraph.operators.graph import TripleGraph
from normgraph.staging import Staged, hot_split_join, stage

_FIRST_IN = ("reg:references",)
_FIRST_IN_REVERSED = ("reg:referencedBy",)
_FIRST_OUT = ("reg:references", "reg:resolvedTarget")


def _arcs(t: DataFrame, forward: Sequence[str], reversed_: Sequence[str] = ()) -> DataFrame:
    """(source, predicate, target) of the predicates; those of ``reversed_`` the other way round."""
    e = t.filter(F.col("p").isin(list(forward))).select(F.col("s").alias("source"), F.col("p").alias("predicate"), F.col("o").alias("target"))
    if reversed_:
        e = e.unionByName(t.filter(F.col("p").isin(list(reversed_))).select(F.col("o").alias("source"), F.col("p").alias("predicate"), F.col("s").alias("target")))
    return e


def impact(g: TripleGraph, start: str, depth: int = 2, direction: str = "both", first_in: Sequence[str] = _FIRST_IN, first_in_reversed: Sequence[str] = _FIRST_IN_REVERSED, first_out: Sequence[str] = _FIRST_OUT, then: Sequence[str] = ("reg:references",)) -> DataFrame:
    """(node, depth, direction, source, predicate, target) of what a provision reaches within ``depth`` steps.

    Direct neighbours come over ``first_in`` (and, read backwards,
    ``first_in_reversed``) and ``first_out``, further ones over ``then``. Each
    node comes once, at its least depth, incoming before outgoing, with the edge
    that found it, the least in (source, predicate, target). ``direction`` is
    'incoming', 'outgoing' or 'both'. A start that is no node gives no rows.
    """
    t = g.triples
    seen = Staged(t.sparkSession.createDataFrame([(start,)], "node string"), "seen")
    frontier, found = seen.df, []
    for step in range(1, depth + 1):
        inward = _arcs(t, first_in, first_in_reversed) if step == 1 else _arcs(t, then)
        outward = _arcs(t, first_out) if step == 1 else _arcs(t, then)
        parts = []
        if direction in ("incoming", "both"):
            parts.append(inward.join(frontier, inward["target"] == frontier["node"]).select(F.col("source").alias("node"), F.lit(0).alias("rank"), "source", "predicate", "target"))
        if direction in ("outgoing", "both"):
            parts.append(outward.join(frontier, outward["source"] == frontier["node"]).select(F.col("target").alias("node"), F.lit(1).alias("rank"), "source", "predicate", "target"))
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        fresh = both.join(seen.df, "node", "left_anti").groupBy("node").agg(F.min(F.struct("rank", "source", "predicate", "target")).alias("e"))
        fresh = Staged(fresh.select("node", F.lit(step).alias("depth"), F.when(F.col("e.rank") == 0, "incoming").otherwise("outgoing").alias("direction"), "e.source", "e.predicate", "e.target"), "found")
        found.append(fresh.df)
        frontier = fresh.df.select("node")
        if step < depth:
            if not frontier.take(1):
                break
            new = Staged(seen.df.unionByName(frontier), "seen")
            seen.drop()
            seen = new
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def impact_summary(nodes: DataFrame) -> DataFrame:
    """(depth, direction, n) over the rows of :func:`impact`."""
    return nodes.groupBy("depth", "direction").agg(F.count(F.lit(1)).alias("n"))


def _neighbours(g: TripleGraph) -> DataFrame:
    t = g.triples
    return t.select(F.col("s").alias("x"), F.col("o").alias("y")).unionByName(t.select(F.col("o").alias("x"), F.col("s").alias("y"))).filter("x <> y").distinct()


def shortest_path(g: TripleGraph, start: str, end: str, most: int = 6) -> DataFrame:
    """(position, node) of a shortest path over all predicates in either direction, at most ``most`` steps.

    Of several, the least in the order of each node's predecessor is taken; no
    path gives no rows; from a node to itself the path is that node.
    """
    spark = g.df.sparkSession
    arcs = stage(_neighbours(g), "neighbours")
    seen = Staged(spark.createDataFrame([(start, [start])], "node string, path array<string>"), "paths")
    frontier = seen.df
    for _ in range(most if start != end else 0):
        near = frontier.join(arcs, frontier["node"] == arcs["x"]).select(F.col("y").alias("node"), F.concat("path", F.array("y")).alias("path"))
        fresh = Staged(near.join(seen.df, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")), "paths")
        new = Staged(seen.df.unionByName(fresh.df), "paths")
        seen.drop()
        seen, frontier = new, fresh.df
        if fresh.df.filter(F.col("node") == end).take(1) or not fresh.df.take(1):
            break
    return seen.df.filter(F.col("node") == end).select(F.posexplode("path").alias("position", "node"))


def subgraph(g: TripleGraph, focus: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth) within ``depth`` steps in either direction, and the triples among them."""
    spark = g.df.sparkSession
    arcs = stage(_neighbours(g), "neighbours")
    seen = Staged(spark.createDataFrame([(focus, 0)], "node string, depth int"), "near")
    frontier = seen.df
    for step in range(1, depth + 1):
        fresh = Staged(frontier.select("node").join(arcs, F.col("node") == F.col("x")).select(F.col("y").alias("node")).distinct().join(seen.df, "node", "left_anti").select("node", F.lit(step).alias("depth")), "near")
        new = Staged(seen.df.unionByName(fresh.df), "near")
        seen.drop()
        seen, frontier = new, fresh.df
    nodes = seen.df
    t = g.triples
    among = t.join(nodes.select(F.col("node").alias("s")), "s", "left_semi").join(nodes.select(F.col("node").alias("o")), "o", "left_semi")
    return nodes, among.select("s", "p", "o")


def contained(g: TripleGraph, container: str, contains: Sequence[str] = ("reg:contains",), part_of: Sequence[str] = ("reg:partOf",)) -> DataFrame:
    """(node, depth) of all that a node contains at any depth; loops end the walk."""
    spark = g.df.sparkSession
    arcs = stage(_arcs(g.triples, contains, part_of).select("source", "target").distinct(), "contains")
    seen = Staged(spark.createDataFrame([(container, 0)], "node string, depth int"), "contained")
    frontier, step = seen.df, 0
    while frontier.take(1):
        step += 1
        fresh = Staged(frontier.select("node").join(arcs, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct().join(seen.df, "node", "left_anti").select("node", F.lit(step).alias("depth")), "contained")
        new = Staged(seen.df.unionByName(fresh.df), "contained")
        seen.drop()
        seen, frontier = new, fresh.df
    return seen.df.filter("depth > 0")


def components(arcs: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph of arcs (x, y); a component is named by its least node.

    Labels spread by minimum over arcs and jump to the label's own label, so that
    long chains take the logarithm of their length. Nodes with null are ignored.
    Nodes with more than a thousandth of all arcs hand out their label by broadcast.
    """
    both = arcs.select("x", "y").unionByName(arcs.select(F.col("y").alias("x"), F.col("x").alias("y"))).dropna()
    both = Staged(both.distinct(), "arcs", n=F.count(F.lit(1)))
    hot_rows = max(1000, both.seen["n"] // 1000)
    first = both.df.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("component"), F.count(F.lit(1)).alias("degree"))
    label = Staged(first, "label", hot=F.count_if(F.col("degree") > hot_rows))
    n_hot = label.seen["hot"]
    while True:
        now = label.df
        near = hot_split_join(both.df, now.select(F.col("node").alias("y"), F.col("component").alias("c"), "degree"), ["y"], "degree", hot_rows, n_hot=n_hot).groupBy("x").agg(F.min("c").alias("near"))
        step = Staged(now.join(near, now["node"] == near["x"]).select("node", "degree", F.col("component").alias("old"), F.least("component", "near").alias("mid")), "step")
        # a label that most nodes have is one key: its label is looked up once for each node that is a label
        marks = step.df.groupBy("mid").agg(F.count(F.lit(1)).alias("n")).join(step.df.select(F.col("node").alias("mid"), F.col("mid").alias("further")), "mid")
        jumped = hot_split_join(step.df, marks, ["mid"], "n", hot_rows).select("node", "degree", "old", F.col("further").alias("component"))
        new = Staged(jumped, "label", changed=F.count_if(F.col("old") != F.col("component")))
        label.drop()
        step.drop()
        label = new
        if not new.seen["changed"]:
            both.drop()
            return new.df.select("node", "component")


def _trimmed(arcs: Staged) -> Staged:
    """Arcs without those of nodes that have no arc in or none out, again and again."""
    while True:
        d = arcs.df
        kept = d.join(d.select(F.col("y").alias("x")).distinct(), "x", "left_semi").join(d.select(F.col("x").alias("y")).distinct(), "y", "left_semi")
        new = Staged(kept.select("x", "y"), "loop", n=F.count(F.lit(1)))
        arcs.drop()
        if new.seen["n"] == arcs.seen["n"]:
            return new
        arcs = new


def loops(arcs: DataFrame) -> DataFrame:
    """(node, loop) of a directed graph of arcs (x, y): the nodes on loops, each with the greatest node that it reaches and that reaches it.

    The greatest node that reaches a node is its colour; of each colour, what leads back to the node that named it
    is one loop. The rest is coloured again.
    """
    spark = arcs.sparkSession
    now = _trimmed(Staged(arcs.select("x", "y").dropna().distinct(), "loop", n=F.count(F.lit(1))))
    found: DataFrame | None = None
    while now.seen["n"]:
        d = now.df
        colour = Staged(d.select(F.col("x").alias("node")).distinct().withColumn("colour", F.col("node")), "colour")
        while True:
            near = d.join(colour.df.withColumnRenamed("node", "x"), "x").groupBy(F.col("y").alias("node")).agg(F.max("colour").alias("near"))
            new = Staged(colour.df.join(near, "node", "left").select("node", F.col("colour").alias("old"), F.greatest("colour", "near").alias("colour")), "colour", changed=F.count_if(F.col("old") != F.col("colour")))
            colour.drop()
            colour = new
            if not new.seen["changed"]:
                break
        c = colour.df.select("node", "colour")
        same = Staged(d.join(c.select(F.col("node").alias("x"), "colour"), "x").join(c.select(F.col("node").alias("y"), "colour"), ["y", "colour"]), "same")
        back = Staged(c.filter("node = colour"), "back")
        fresh = back.df
        while True:
            more = same.df.join(fresh.withColumnRenamed("node", "y"), ["y", "colour"]).select(F.col("x").alias("node"), "colour").distinct().join(back.df, ["node", "colour"], "left_anti")
            step = Staged(more, "back", n=F.count(F.lit(1)))
            if not step.seen["n"]:
                break
            back, fresh = Staged(back.df.unionByName(step.df), "back"), step.df
        # a node alone is on a loop only by an arc to itself
        own = same.df.filter("x = y").select(F.col("x").alias("node"), F.lit(True).alias("own"))
        sizes = back.df.groupBy("colour").agg(F.count(F.lit(1)).alias("n"))
        part = stage(back.df.join(sizes, "colour").join(own, "node", "left").filter("n > 1 or own").select("node", F.col("colour").alias("loop")), "loops")
        found = part if found is None else found.unionByName(part)
        left = same.df.select("x", "y").join(back.df.select(F.col("node").alias("x")), "x", "left_anti").join(back.df.select(F.col("node").alias("y")), "y", "left_anti")
        now = _trimmed(Staged(left, "loop", n=F.count(F.lit(1))))
    return found if found is not None else spark.createDataFrame([], f"node {arcs.schema['x'].dataType.simpleString()}, loop {arcs.schema['x'].dataType.simpleString()}")


def on_loops(arcs: DataFrame) -> DataFrame:
    """(node) of a directed graph of arcs (x, y) that lie on a loop or between loops.

    Nodes without an arc in or without an arc out are taken away until none is left to take.
    """
    kept = _trimmed(Staged(arcs.select("x", "y").dropna().distinct(), "loop", n=F.count(F.lit(1))))
    return kept.df.select(F.col("x").alias("node")).distinct()


def chain_to_root(links: DataFrame, start: str, most: int = 1000) -> DataFrame:
    """(position, node): the nodes found by following (node, found_by) upward from ``start``; a loop ends it."""
    spark = links.sparkSession
    spark_links = links.groupBy("node").agg(F.min("found_by").alias("found_by"))
    out, at = [start], start
    for _ in range(most):  # one short lookup per step of one chain
        row = spark_links.filter(F.col("node") == at).select("found_by").take(1)
        if not row or not row[0][0] or row[0][0] in out:
            break
        at = row[0][0]
        out.append(at)
    return spark.createDataFrame(list(enumerate(out)), "position int, node string")

"""Relational tables seen as graphs of triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.operators.graph import TripleGraph

#: Table: key columns, and predicate of each column with the class its values refer to, if any.
RELATIONAL = {
    "region": (["r_regionkey"], {"t:name": ("r_name", None)}),
    "nation": (["n_nationkey"], {"t:name": ("n_name", None), "t:region": ("n_regionkey", "region")}),
    "customer": (["c_custkey"], {"t:name": ("c_name", None), "t:nation": ("c_nationkey", "nation"), "t:segment": ("c_mktsegment", None), "t:balance": ("c_acctbal", None)}),
    "supplier": (["s_suppkey"], {"t:name": ("s_name", None), "t:nation": ("s_nationkey", "nation"), "t:balance": ("s_acctbal", None)}),
    "part": (["p_partkey"], {"t:name": ("p_name", None), "t:brand": ("p_brand", None), "t:size": ("p_size", None)}),
    "orders": (["o_orderkey"], {"t:customer": ("o_custkey", "customer"), "t:status": ("o_orderstatus", None), "t:priority": ("o_orderpriority", None), "t:total": ("o_totalprice", None)}),
    "lineitem": (["l_orderkey", "l_linenumber"], {"t:order": ("l_orderkey", "orders"), "t:part": ("l_partkey", "part"), "t:supplier": ("l_suppkey", "supplier"), "t:quantity": ("l_quantity", None), "t:flag": ("l_returnflag", None)}),
}
#: Tables whose keys repeat, and whose triples therefore have to be made a set.
REPEATED = ("lineitem",)


def _uri(kind: str, *columns: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in columns])


def table_triples(df: DataFrame, table: str) -> DataFrame:
    """(s, p, o) of one table.

    One select per column, so that a filter on the predicate folds the other
    branches away and a query reads only the columns it asks for.
    """
    keys, columns = RELATIONAL[table]
    s = _uri(table, *keys).alias("s")
    # where keys repeat, the columns of a branch are made distinct before they become text: each branch is a set then, and so is their union
    once = lambda *c: df.select(*dict.fromkeys(c)).distinct() if table in REPEATED else df
    parts = [once(*keys).select(s, F.lit("rdf:type").alias("p"), F.lit(f"t:{table.capitalize()}").alias("o"))]
    for p, (column, target) in columns.items():
        o = _uri(target, column) if target else F.col(column).cast("string")
        parts.append(once(*keys, column).filter(F.col(column).isNotNull()).select(s, F.lit(p).alias("p"), o.alias("o")))
    return reduce(DataFrame.unionByName, parts)


def relational_graph(spark: SparkSession, d: str, tables: tuple[str, ...] = tuple(RELATIONAL)) -> TripleGraph:
    """The tables of a folder as one graph, a set already."""
    return TripleGraph(reduce(DataFrame.unionByName, [table_triples(spark.read.parquet(f"{d}/{t}.parquet"), t) for t in tables]), distinct=False)


def provision_graph(spark: SparkSession, d: str) -> TripleGraph:
    """The serialized triples of the library, one graph over all documents, predicates in their short form."""
    names = spark.read.parquet(f"{d}/attributes.parquet").select(F.col("full_uri").alias("long"), F.col("predicate").alias("short"))
    t = spark.read.parquet(f"{d}/triples.parquet").select(F.col("subject").alias("s"), "predicate", F.col("object").alias("o"), F.col("document").alias("doc"))
    t = t.join(F.broadcast(names), t["predicate"] == names["long"], "left").select("s", F.coalesce("short", "predicate").alias("p"), "o", "doc")
    return TripleGraph(t)

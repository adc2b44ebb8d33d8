"""Documents of a library against each other: overlaps, external references, matrices and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(items: DataFrame, concept: str = "concept", doc: str = "doc", provision: str = "provision", least: int = 2) -> DataFrame:
    """(concept, n_docs, docs) of concepts in at least ``least`` documents; docs lists (doc, n_provisions), sorted.

    Provisions are counted before the lists are built, so a list has one entry per document. Null concepts are ignored.
    """
    per_doc = items.filter(F.col(concept).isNotNull()).groupBy(F.col(concept).alias("concept"), F.col(doc).alias("doc")).agg(F.countDistinct(provision).alias("n"))
    out = per_doc.groupBy("concept").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_provisions"), F.sort_array(F.collect_list(F.struct("doc", "n"))).alias("docs"))
    return out.filter(F.col("n_docs") >= least)


def compare_documents(items: DataFrame, a: str, b: str, concept: str = "concept", doc: str = "doc") -> DataFrame:
    """(concept, side): 'shared', or only in 'a' or 'b'."""
    mine = items.filter(F.col(doc).isin(a, b) & F.col(concept).isNotNull()).groupBy(F.col(concept).alias("concept")).agg(F.max(F.col(doc) == a).alias("x"), F.max(F.col(doc) == b).alias("y"))
    return mine.select("concept", F.when(F.col("x") & F.col("y"), "shared").when(F.col("x"), "a").otherwise("b").alias("side"))


def reference_clusters(refs: DataFrame, target: Column, source: Sequence[str] = ("document", "provision")) -> DataFrame:
    """(target, n, n_documents): how often, and from how many documents, each normalised target is referred to."""
    r = refs.withColumn("target", target).filter("target is not null and target <> ''")
    return r.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(source[0]).alias("n_documents"))


def reference_matrix(pairs: DataFrame, source: str = "source", target: str = "target", labels: Sequence[str] | None = None) -> DataFrame:
    """Counts of references between rules as a matrix: one row per source, one column per target, the diagonal left out.

    ``labels`` fixes the columns; without them, the targets found make the columns (Spark allows 10,000).
    """
    p = pairs.filter(F.col(source) != F.col(target)).groupBy(F.col(source).alias("source"))
    p = p.pivot(target, list(labels)) if labels is not None else p.pivot(target)
    return p.agg(F.count(F.lit(1))).na.fill(0)


def matrix_margins(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(rule, n_out, n_in) of the references between different rules."""
    e = pairs.filter(F.col(source) != F.col(target))
    ends = e.select(F.col(source).alias("rule"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col(target).alias("rule"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("rule").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def document_summary(triples: DataFrame, doc: str = "document") -> DataFrame:
    """Counts per document: triples, subjects, and triples of the types and relations of interest."""
    t = triples
    typed = lambda name: F.count_if((F.col("p") == "rdf:type") & (F.col("o") == name))
    return t.groupBy(F.col(doc).alias("doc")).agg(
        F.count(F.lit(1)).alias("n_triples"), F.countDistinct("s").alias("n_subjects"), typed("reg:Article").alias("n_articles"), typed("reg:Chapter").alias("n_chapters"),
        F.count_if(F.col("p") == "reg:references").alias("n_references"), F.count_if(F.col("p") == "reg:term").alias("n_terms"), F.count_if(F.col("p") == "reg:partOf").alias("n_parts"),
    )


def keyed_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, change, before, after): full outer comparison of two maps; unchanged keys are left out. Nulls are equal to nulls."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("in_a"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return a.join(b, list(keys), "full_outer").withColumn("change", change).filter("change is not null").select(*keys, "change", "before", "after")

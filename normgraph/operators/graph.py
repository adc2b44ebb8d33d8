"""A graph of string triples as one DataFrame, with the operations of a triple store."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.plans.compiler import Compiler
from normgraph.plans.sparql import Query

#: The namespaces of the ontology and their short forms.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "owl": "http://www.w3.org/2002/07/owl#",
    "dc": "http://purl.org/dc/terms/", "eli": "http://data.europa.eu/eli/ontology#", "frbr": "http://purl.org/vocab/frbr/core#",
}

#: Predicates that relate two resources, for graph exports.
RELATIONS = (
    "reg:partOf", "reg:contains", "reg:belongsTo", "reg:hasChapter", "reg:hasSection", "reg:hasArticle", "reg:hasParagraph", "reg:hasPoint", "reg:hasRecital",
    "reg:references", "reg:referencedBy", "reg:refersToArticle", "reg:refersToChapter", "reg:refersToPoint",
    "reg:defines", "reg:definedIn", "reg:usesTerm", "reg:grantsRight", "reg:imposesObligation",
    "reg:amends", "reg:amendedBy", "reg:supersedes", "reg:supersededBy", "reg:repeals", "reg:repealedBy", "reg:delegatesTo",
    "reg:resolvedTarget", "reg:alternativeTarget", "reg:externalRef",
    "eli:is_part_of", "eli:has_part", "eli:cites", "eli:cited_by",
)


class TripleGraph:
    """Distinct triples (s, p, o) of non-empty strings, optionally with a graph name ``g`` or a document ``doc``.

    Operations return new frames or graphs and leave this one as it is. Triples
    with a null or empty part are left out on creation, as bulk loading does;
    ``distinct=False`` trusts that the frame is a set already and adds no shuffle.
    """

    def __init__(self, df: DataFrame, distinct: bool = True):
        keep = [c for c in ("s", "p", "o", "g", "doc") if c in df.columns]
        df = df.select(*[F.col(c).cast("string").alias(c) for c in keep])
        for c in "spo":
            df = df.filter(F.col(c) != "")
        self.df = df.dropDuplicates(keep) if distinct else df

    @classmethod
    def of(cls, spark: SparkSession, triples: Iterable[tuple[str, str, str]]) -> "TripleGraph":
        return cls(spark.createDataFrame(list(triples), "s string, p string, o string"))

    @property
    def triples(self) -> DataFrame:
        """(s, p, o), each once."""
        return self.df.select("s", "p", "o") if set(self.df.columns) == set("spo") else self.df.select("s", "p", "o").distinct()

    # lookups; an empty string or None matches anything

    def _match(self, s: str | None = None, p: str | None = None, o: str | None = None) -> Column:
        out = F.lit(True)
        for c, v in (("s", s), ("p", p), ("o", o)):
            if v:
                out = out & (F.col(c) == v)
        return out

    def find(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Triples of a pattern; one plan for all eight access paths, filters go to the scan."""
        return self.triples.filter(self._match(s, p, o))

    def exists(self, s: str | None = None, p: str | None = None, o: str | None = None) -> bool:
        return bool(self.find(s, p, o).take(1))

    def properties(self, s: str) -> DataFrame:
        """(p, objects) of a subject, objects sorted."""
        return self.find(s).groupBy("p").agg(F.sort_array(F.collect_list("o")).alias("objects"))

    def one(self, s: str, p: str) -> DataFrame:
        """The least object of a subject and predicate, in code-point order."""
        return self.find(s, p).agg(F.min("o").alias("o")).filter("o is not null")

    def subjects(self) -> DataFrame:
        return self.df.select("s").distinct()

    def predicates(self) -> DataFrame:
        return self.df.select("p").distinct()

    def objects(self) -> DataFrame:
        return self.df.select("o").distinct()

    # changes

    def add(self, more: DataFrame) -> "TripleGraph":
        """With the triples of ``more``; invalid ones are skipped, repeated ones stay single."""
        return TripleGraph(self.df.unionByName(TripleGraph(more, distinct=False).df, allowMissingColumns=True))

    def added_by(self, more: DataFrame) -> DataFrame:
        """Triples that ``more`` would add."""
        return TripleGraph(more).triples.join(self.triples, ["s", "p", "o"], "left_anti")

    def delete(self, s: str | None = None, p: str | None = None, o: str | None = None) -> "TripleGraph":
        return TripleGraph(self.df.filter(~self._match(s, p, o)), distinct=False)

    def delete_all(self, triples: DataFrame) -> "TripleGraph":
        return TripleGraph(self.df.join(triples.select("s", "p", "o"), ["s", "p", "o"], "left_anti"), distinct=False)

    # statistics

    def stats(self) -> DataFrame:
        """One row: triples, and distinct subjects, predicates and objects."""
        # each count by itself: the columns it does not need are not read, and no row is copied for the others
        out = self.triples.agg(F.count(F.lit(1)).alias("triples"))
        for c, name in (("s", "subjects"), ("p", "predicates"), ("o", "objects")):
            out = out.crossJoin(self.df.select(c).distinct().agg(F.count(F.lit(1)).alias(name)))  # one row each
        return out

    def counts(self, position: str) -> DataFrame:
        """Triples per subject, predicate or object."""
        return self.triples.groupBy(position).agg(F.count(F.lit(1)).alias("n"))

    def predicate_counts(self, most: int = 10_000) -> dict[str, int]:
        """Triples per predicate, for join ordering; the ``most`` frequent ones."""
        return {r["p"]: r["n"] for r in self.counts("p").orderBy(F.desc("n"), "p").limit(most).collect()}

    # queries

    def query(self, text: str | Query, counts: dict[str, int] | None = None, compat: bool = False, expand_prefixes: bool = False) -> DataFrame:
        """Result of a SELECT, CONSTRUCT or DESCRIBE query."""
        return Compiler(self.triples, counts, compat).run(text, expand_prefixes)

    # views

    def labels(self, order: tuple[str, ...] = ("reg:title", "rdfs:label", "reg:term"), longest: dict[str, int] | None = None) -> DataFrame:
        """(s, label): the first of the predicates in ``order`` that a subject has, the least object of
        several, else the tail of its URI. ``longest`` bounds the length a predicate's object may have."""
        longest = longest or {}
        picks = []
        for k, p in enumerate(order):
            fits = F.length("o") < longest[p] if p in longest else F.lit(True)
            picks.append(F.min(F.when((F.col("p") == p) & fits, F.col("o"))).alias(f"c{k}"))
        g = self.triples.groupBy("s").agg(*picks)
        return g.select("s", F.coalesce(*[F.col(f"c{k}") for k in range(len(order))], uri_tail(F.col("s"))).alias("label"))

    def types(self) -> DataFrame:
        """(s, type): the tail of the least rdf:type."""
        return self.find(p="rdf:type").groupBy("s").agg(F.min("o").alias("o")).select("s", uri_tail(F.col("o")).alias("type"))

    def nodes_and_edges(self, relations: tuple[str, ...] = RELATIONS) -> tuple[DataFrame, DataFrame]:
        """Nodes (id, type, label) and edges (source, predicate, target) of the relations between resources."""
        uri = F.col("o").rlike(r"^(https?://|urn:|[\w-]+:)") & ~F.col("o").contains(" ")
        edges = self.triples.filter(F.col("p").isin(list(relations)) & uri).select(F.col("s").alias("source"), F.col("p").alias("predicate"), F.col("o").alias("target"))
        ids = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
        nodes = ids.join(self.types().withColumnRenamed("s", "id"), "id", "left").join(self.labels(("rdfs:label", "reg:title", "reg:term"), {"reg:title": 50}).withColumnRenamed("s", "id"), "id", "left")
        return nodes.select("id", F.coalesce("type", F.lit("Unknown")).alias("type"), F.coalesce("label", uri_tail(F.col("id"))).alias("label")), edges


def uri_tail(uri: Column) -> Column:
    """What follows the last of # / : in a URI."""
    return F.regexp_extract(uri, r"([^#/:]*)$", 1)


def relationship_summary(g: TripleGraph, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(node, out_degree, in_degree) over the relations."""
    e = g.triples.filter(F.col("p").isin(list(relations)))
    ends = e.select(F.col("s").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("o").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def compact_uris(df: DataFrame, columns: Iterable[str] | None = None, namespaces: dict[str, str] = NAMESPACES) -> DataFrame:
    """Full URIs in the columns to prefix:name, the longest namespace first."""
    for c in columns or df.columns:
        e = F.col(f"`{c}`")
        out = e
        for short, full in sorted(namespaces.items(), key=lambda x: len(x[1])):
            out = F.when(e.startswith(full), F.concat(F.lit(f"{short}:"), e.substr(F.lit(len(full) + 1), F.length(e)))).otherwise(out)
        df = df.withColumn(c, out)
    return df

"""Graphs from and to RDF text forms, JSON, CSV and DOT, built row by row in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.functions.text import escape_literal, escape_xml
from normgraph.operators.graph import NAMESPACES, compact_uris


def _iri(c: Column) -> Column:
    return c.contains("://") | c.startswith("urn:")


def _prefixed(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_][\w.-]*:[^\s]+$") & ~_iri(c)


def ntriples_term(c: Column) -> Column:
    return F.when(_iri(c) | _prefixed(c), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(F.concat(F.lit('"'), escape_literal(c), F.lit('"')))


def turtle_term(c: Column) -> Column:
    return F.when(_iri(c), F.concat(F.lit("<"), c, F.lit(">"))).when(_prefixed(c), c).otherwise(F.concat(F.lit('"'), escape_literal(c), F.lit('"')))


def ntriples(t: DataFrame) -> DataFrame:
    """(line): one statement per triple."""
    return t.select(F.concat_ws(" ", ntriples_term(F.col("s")), ntriples_term(F.col("p")), ntriples_term(F.col("o")), F.lit(".")).alias("line"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of an N-Triples file; other lines are skipped."""
    term = r'(<[^>]*>|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[\w-]+)?)'
    rows = spark.read.text(path).select(F.regexp_extract("value", rf"^\s*{term}\s+{term}\s+{term}\s*\.\s*$", 0).alias("v"), *[F.regexp_extract("value", rf"^\s*{term}\s+{term}\s+{term}\s*\.\s*$", k).alias(c) for k, c in enumerate("spo", 1)]).filter("v <> ''")

    def plain(c: Column) -> Column:
        text = F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)
        for raw, to in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
            text = F.replace(text, F.lit(raw), F.lit(to))
        return F.when(c.startswith("<"), F.substring(c, 2, 1_000_000_000).substr(F.lit(1), F.length(c) - 2)).otherwise(text)

    return rows.select(*[plain(F.col(c)).alias(c) for c in "spo"])


def _grouped(t: DataFrame) -> DataFrame:
    """(s, ps): predicates of each subject, rdf:type first, each with its sorted objects."""
    by_p = t.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("os"))
    return by_p.groupBy("s").agg(F.sort_array(F.collect_list(F.struct((F.col("p") != "rdf:type").alias("k"), "p", "os"))).alias("ps"))


def turtle(t: DataFrame, namespaces: dict[str, str] = NAMESPACES) -> DataFrame:
    """(s, block): one Turtle block per subject, to be written in the order of s after :func:`turtle_head`.

    URIs of the namespaces are written with their prefixes.
    """
    t = compact_uris(t.select("s", "p", "o"), namespaces=namespaces)
    predicate = lambda p: F.when(p == "rdf:type", "a").otherwise(turtle_term(p))
    line = lambda x: F.concat(F.lit("    "), predicate(x["p"]), F.lit(" "), F.array_join(F.transform(x["os"], turtle_term), ", "))
    return _grouped(t).select("s", F.concat(turtle_term(F.col("s")), F.lit("\n"), F.array_join(F.transform("ps", line), " ;\n"), F.lit(" .\n")).alias("block"))


def turtle_head(namespaces: dict[str, str] = NAMESPACES) -> str:
    return "".join(f"@prefix {k}: <{v}> .\n" for k, v in sorted(namespaces.items())) + "\n"


def jsonld(t: DataFrame) -> DataFrame:
    """(s, json): one expanded JSON-LD node per subject; predicates in order, single objects as text, several as a list."""
    value = lambda os: F.when(F.size(os) == 1, F.to_json(F.struct(os[0].alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(os[0].alias("v")))) - 6)).otherwise(F.to_json(os))
    quote = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    pair = lambda x: F.concat(F.when(x["p"] == "rdf:type", F.lit('"@type"')).otherwise(quote(x["p"])), F.lit(":"), value(x["os"]))
    return _grouped(t).select("s", F.concat(F.lit('{"@id":'), quote(F.col("s")), F.lit(","), F.array_join(F.transform("ps", pair), ","), F.lit("}")).alias("json"))


def rdfxml(t: DataFrame) -> DataFrame:
    """(s, block): one rdf:Description per subject."""
    item = lambda p, o: F.when(_iri(o), F.concat(F.lit("    <"), p, F.lit(' rdf:resource="'), escape_xml(o), F.lit('"/>'))).otherwise(F.concat(F.lit("    <"), p, F.lit(">"), escape_xml(o), F.lit("</"), p, F.lit(">")))
    body = F.array_join(F.flatten(F.transform("ps", lambda x: F.transform(x["os"], lambda o: item(x["p"], o)))), "\n")
    return _grouped(t).select("s", F.concat(F.lit('  <rdf:Description rdf:about="'), escape_xml(F.col("s")), F.lit('">\n'), body, F.lit("\n  </rdf:Description>")).alias("block"))


def dot(edges: DataFrame) -> DataFrame:
    """(line): edges (source, predicate, target) as DOT statements."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), q("source"), F.lit(" -> "), q("target"), F.lit(" [label="), q("predicate"), F.lit("];")).alias("line"))


def read_json_triples(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """(s, p, o) of JSON objects {subject, predicate, object}, one per line, or in one array per file."""
    rows = spark.read.schema("subject string, predicate string, object string").json(path, multiLine=arrays)
    return rows.selectExpr("subject as s", "predicate as p", "object as o").dropna()


def write_json_triples(t: DataFrame, path: str) -> None:
    t.selectExpr("s as subject", "p as predicate", "o as object").write.mode("overwrite").json(path)

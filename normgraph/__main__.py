"""python -m normgraph COMMAND: query, impact, export, ingest and library work on folders of triples or documents."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.operators import extraction, traversal, versions
from normgraph.operators.graph import TripleGraph
from normgraph.plans import templates
from normgraph.sources import files, rdf
from normgraph.sources.library import Library


def _load(spark: SparkSession, path: str) -> TripleGraph:
    """A graph of N-Triples, JSON triples, or Parquet with columns s, p, o or subject, predicate, object."""
    if path.endswith(".nt"):
        return TripleGraph(rdf.read_ntriples(spark, path))
    if path.endswith(".json"):
        return TripleGraph(rdf.read_json_triples(spark, path, arrays=True))
    return TripleGraph(spark.read.parquet(path).withColumnsRenamed({"subject": "s", "predicate": "p", "object": "o", "document": "doc"}))


def _show(df: DataFrame, form: str, out: str | None) -> None:
    if out:
        w = df.write.mode("overwrite")
        {"csv": lambda: w.option("header", True).csv(out), "json": lambda: w.json(out), "table": lambda: w.parquet(out)}[form]()
    elif form == "json":
        for line in df.toJSON().toLocalIterator():
            print(line)
    elif form == "csv":
        print(",".join(df.columns))
        for r in df.toLocalIterator():
            print(",".join('"' + str(v).replace('"', '""') + '"' if v is not None else "" for v in r))
    else:
        df.show(100, truncate=60)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="normgraph")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("query", "impact", "export", "stats"):
        p = sub.add_parser(name)
        p.add_argument("graph")
        p.add_argument("--form", default="table" if name != "export" else "nt")
        p.add_argument("--out")
        if name == "query":
            p.add_argument("query", nargs="?", help="a query, or the name of a template")
            p.add_argument("--set", action="append", default=[], help="a template's parameter, NAME=VALUE")
            p.add_argument("--compat", action="store_true")
        if name == "impact":
            p.add_argument("provision")
            p.add_argument("--depth", type=int, default=2)
            p.add_argument("--direction", default="both", choices=("both", "incoming", "outgoing"))
    p = sub.add_parser("ingest", help="text files to a library")
    p.add_argument("texts")
    p.add_argument("library")
    for name, text in (("refs", "references of text files"), ("search", "text files that hold words")):
        p = sub.add_parser(name, help=text)
        p.add_argument("texts")
        p.add_argument("words", nargs="*")
        p.add_argument("--form", default="table")
        p.add_argument("--out")
    p = sub.add_parser("library", help="list, stats, query or remove documents of a library")
    p.add_argument("action", choices=("list", "stats", "query", "remove"))
    p.add_argument("library")
    p.add_argument("what", nargs="*", help="a query, or names of documents")
    p.add_argument("--form", default="table")
    p.add_argument("--out")
    p = sub.add_parser("compare", help="predicates in which two subjects of a graph differ")
    p.add_argument("graph")
    p.add_argument("a")
    p.add_argument("b")
    p.add_argument("--form", default="table")
    p.add_argument("--out")
    sub.add_parser("templates")
    a = parser.parse_args(argv)
    if a.command == "templates":
        print("\n".join(templates.TEMPLATES))
        return 0
    spark = SparkSession.builder.appName("normgraph").getOrCreate()
    if a.command == "ingest":
        docs = files.read_texts(spark, a.texts).withColumn("doc", F.regexp_extract("path", r"([^/]+?)(?:\.\w+)?$", 1))
        triples = extraction.provision_triples(docs, F.col("doc"), "doc").withColumn("doc", F.split_part("s", F.lit(":"), F.lit(1)))
        Library(spark, a.library).add(triples)
        return 0
    if a.command in ("refs", "search"):
        docs = files.read_texts(spark, a.texts)
        found = extraction.references(docs, "path").drop("levels") if a.command == "refs" else extraction.keyword_search(docs, a.words, key="path").orderBy(F.desc("score"), "path")
        _show(found, a.form, a.out)
        return 0
    if a.command == "library":
        lib = Library(spark, a.library)
        if a.action == "remove":
            lib.remove(*a.what)
        else:
            _show({"list": lambda: lib.documents().drop("tags"), "stats": lib.stats, "query": lambda: lib.graph().query(" ".join(a.what))}[a.action](), a.form, a.out)
        return 0
    g = _load(spark, a.graph)
    if a.command == "compare":
        _show(versions.compare_versions(g.triples, a.a, a.b), a.form, a.out)
        return 0
    if a.command == "query":
        text = templates.render(a.query, **dict(s.split("=", 1) for s in a.set)) if a.query in templates.TEMPLATES else a.query
        _show(g.query(text, compat=a.compat), a.form, a.out)
    elif a.command == "impact":
        _show(traversal.impact(g, a.provision, a.depth, a.direction), a.form, a.out)
    elif a.command == "stats":
        _show(g.stats(), a.form, a.out)
    else:
        df = {"nt": lambda: rdf.ntriples(g.triples), "turtle": lambda: rdf.turtle(g.triples), "jsonld": lambda: rdf.jsonld(g.triples), "rdfxml": lambda: rdf.rdfxml(g.triples), "dot": lambda: rdf.dot(g.nodes_and_edges()[1])}[a.form]()
        _show(df.select(df.columns[-1]), "csv" if a.out else "json", a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

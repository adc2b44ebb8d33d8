"""The query engine, walks, versions, votes, extraction, files, library and streams on small fixtures."""

import io
import itertools
import json
import random
import zipfile
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from normgraph.functions import text as fn
from normgraph.operators import documents as docs
from normgraph.operators import extraction as ex
from normgraph.operators import traversal as walk
from normgraph.operators import versions as ver
from normgraph.operators import voting
from normgraph.operators.graph import TripleGraph, compact_uris
from normgraph.plans import templates
from normgraph.plans.compiler import order
from normgraph.plans.sparql import SparqlError, parse
from normgraph.sources import files, rdf
from normgraph.sources.library import Library
from normgraph.streaming import watch
from tests.conftest import rows

TRIPLES = [
    ("r:A1", "rdf:type", "reg:Article"), ("r:A1", "reg:title", "Scope"), ("r:A1", "reg:number", "1"), ("r:A1", "reg:partOf", "r:C1"), ("r:A1", "reg:references", "r:A2"),
    ("r:A2", "rdf:type", "reg:Article"), ("r:A2", "reg:title", "Terms"), ("r:A2", "reg:number", "2"), ("r:A2", "reg:partOf", "r:C1"), ("r:A2", "reg:references", "r:A3"),
    ("r:A3", "rdf:type", "reg:Article"), ("r:A3", "reg:title", "Erasure \"now\""), ("r:A3", "reg:number", "10"), ("r:A3", "reg:partOf", "r:C2"), ("r:A3", "reg:references", "r:A1"),
    ("r:C1", "rdf:type", "reg:Chapter"), ("r:C1", "reg:title", "General"), ("r:C2", "rdf:type", "reg:Chapter"), ("r:C2", "reg:title", "Rights"), ("r:A3", "reg:note", "x"), ("r:A3", "reg:note", "x"),
]


@pytest.fixture(scope="module")
def g(spark):
    return TripleGraph.of(spark, TRIPLES)


@pytest.mark.parametrize(("query", "want"), [
    ("SELECT ?a ?t WHERE { ?a a reg:Article . ?a reg:title ?t . ?a reg:number ?n . FILTER(?n > 1) }", [("r:A2", "Terms"), ("r:A3", 'Erasure "now"')]),
    ("SELECT ?a WHERE { ?a reg:number ?n FILTER(?n = 10 || ?n = 1) }", [("r:A1",), ("r:A3",)]),
    ('SELECT ?a WHERE { ?a reg:title ?t . FILTER(REGEX(?t, "^e", "i") && CONTAINS(STR(?t), "now")) }', [("r:A3",)]),
    ("SELECT ?a ?x WHERE { ?a a reg:Article . OPTIONAL { ?a reg:note ?x } }", [("r:A1", None), ("r:A2", None), ("r:A3", "x")]),
    ("SELECT ?a WHERE { ?a a reg:Article . OPTIONAL { ?a reg:note ?x } FILTER(!BOUND(?x)) }", [("r:A1",), ("r:A2",)]),
    ("SELECT ?a ?y WHERE { ?a a reg:Chapter . OPTIONAL { ?a reg:note ?y } OPTIONAL { ?b reg:note ?y } }", [("r:C1", "x"), ("r:C2", "x")]),
    ("SELECT ?c (COUNT(?a) AS ?n) (SUM(?k) AS ?s) WHERE { ?a reg:partOf ?c ; reg:number ?k } GROUP BY ?c HAVING(COUNT(?a) > 1)", [("r:C1", 2, 3.0)]),
    ("SELECT (MAX(?k) AS ?m) (MIN(?t) AS ?l) WHERE { ?a reg:number ?k ; reg:title ?t }", [("10", 'Erasure "now"')]),
    ("SELECT (COUNT(?a) AS ?n) WHERE { ?a reg:nothing ?k }", []),
    ("SELECT DISTINCT ?c WHERE { ?a reg:partOf ?c }", [("r:C1",), ("r:C2",)]),
    ("SELECT ?x WHERE { ?x ?p ?x }", []),
    ("SELECT ?a ?b ?c WHERE { ?a reg:references ?b . ?b reg:references ?c . ?c reg:references ?a . FILTER(?a < ?b) FILTER(?b < ?c) }", [("r:A1", "r:A2", "r:A3")]),
    ("CONSTRUCT { ?b reg:referencedBy ?a } WHERE { ?a reg:references ?b ; reg:note ?x }", [("r:A1", "reg:referencedBy", "r:A3")]),
    ("DESCRIBE r:C2", [("r:A3", "reg:partOf", "r:C2"), ("r:C2", "rdf:type", "reg:Chapter"), ("r:C2", "reg:title", "Rights")]),
    ('DESCRIBE ?c WHERE { ?c reg:title "Rights" }', [("r:A3", "reg:partOf", "r:C2"), ("r:C2", "rdf:type", "reg:Chapter"), ("r:C2", "reg:title", "Rights")]),
])
def test_queries(g, query, want):
    assert rows(g.query(query)) == sorted(want, key=str)
    again = str(parse(query))
    assert str(parse(again)) == again  # the printed form is a fixed point


def test_order_and_slices(g):
    q = "SELECT ?a ?n WHERE { ?a reg:number ?n } ORDER BY DESC(?n) LIMIT 1 OFFSET 1"
    assert [tuple(r) for r in g.query(q).collect()] == [("r:A3", "10")]  # text order: 2, 10, 1


@pytest.mark.parametrize("bad", ["", "ASK { ?s ?p ?o }", "SELECT WHERE { ?s ?p ?o }", "SELECT ?s WHERE { ?s ?p }", "SELECT ?x WHERE { ?s ?p ?o }", "SELECT ?s (COUNT(?o) AS ?n) WHERE { ?s ?p ?o }", "DESCRIBE", "SELECT ?s WHERE { ?s ?p ?o } LIMIT"])
def test_bad_queries(g, bad):
    with pytest.raises((SparqlError, ValueError)):
        g.query(bad)


def test_compat_keeps_the_literal_behaviour(g):
    q = "SELECT ?a WHERE { ?a a reg:Article . OPTIONAL { ?a reg:note ?x } FILTER(!BOUND(?x)) }"
    assert rows(g.query(q, compat=True)) == [("r:A3",)]
    q = "SELECT ?a WHERE { ?a a reg:Article . OPTIONAL { ?a reg:note ?x } FILTER(?x > 3) }"
    assert rows(g.query(q, compat=True), "a") == [("r:A1",), ("r:A2",), ("r:A3",)] and rows(g.query(q)) == []


def test_prefixes_and_order():
    q = parse("PREFIX reg: <http://r/> SELECT ?s WHERE { ?s reg:title ?o . <u> reg:x ?s }")
    assert str(q.expand_prefixes().where.patterns[0].p) == "<http://r/title>"
    p = parse("SELECT * WHERE { ?a x:p ?b . ?c x:q ?d . ?b x:r ?c . <k> x:q ?d }").where.patterns
    first = order(p, {"x:p": 1000, "x:q": 10, "x:r": 1000})
    assert [str(x) for x in first] == ["<k> x:q ?d .", "?c x:q ?d .", "?b x:r ?c .", "?a x:p ?b ."]


def test_templates(g):
    for name in templates.TEMPLATES:
        assert g.query(templates.render(name)).count() >= 0
    assert rows(g.query(templates.render("search", word="cop")), "x") == [("r:A1",)]
    with pytest.raises(ValueError):
        templates.render("search", word='"')


def test_store(spark, g):
    assert g.triples.count() == len(set(TRIPLES)) and g.exists("r:A1", None, "r:A2") and not g.exists(p="none")
    more = spark.createDataFrame([("r:A1", "reg:title", "Scope"), ("r:N", "reg:title", "New"), ("", "p", "o"), (None, "p", "o")], "s string, p string, o string")
    assert rows(g.added_by(more)) == [("r:N", "reg:title", "New")]
    assert g.add(more).triples.count() == g.triples.count() + 1
    assert g.delete(p="reg:title").find(p="reg:title").count() == 0
    assert rows(g.properties("r:A3").filter("p = 'reg:note'")) == [("reg:note", ["x"])]
    assert rows(g.one("r:A2", "reg:title")) == [("Terms",)]
    s = g.stats().collect()[0]
    assert (s["triples"], s["subjects"], s["predicates"]) == (20, 5, 6)
    nodes, edges = g.nodes_and_edges()
    assert edges.count() == 6 and ("r:C1", "Chapter", "General") in rows(nodes)
    df = spark.createDataFrame([("http://purl.org/dc/terms/title",)], "x string")
    assert rows(compact_uris(df)) == [("dc:title",)]


def test_walks(spark, g):
    got = rows(walk.impact(g, "r:A1", 2, "both"), "node", "depth", "direction")
    assert got == [("r:A2", 1, "outgoing"), ("r:A3", 1, "incoming")]
    assert rows(walk.impact(g, "r:A1", 3, "outgoing"), "node", "depth") == [("r:A2", 1), ("r:A3", 2)]
    assert walk.impact(g, "nobody", 2).count() == 0
    assert [r["node"] for r in walk.shortest_path(g, "r:C1", "r:C2").orderBy("position").collect()] in (["r:C1", "r:A1", "r:A3", "r:C2"], ["r:C1", "r:A2", "r:A3", "r:C2"], ["r:C1", "reg:Chapter", "r:C2"])
    assert rows(walk.shortest_path(g, "r:C1", "r:C1")) == [(0, "r:C1")] and walk.shortest_path(g, "r:C1", "nobody").count() == 0
    nodes, among = walk.subgraph(g, "r:C2", 1)
    assert ("r:A3", 1) in rows(nodes) and ("r:A3", "reg:partOf", "r:C2") in rows(among)
    assert rows(walk.contained(g, "r:C1")) == [("r:A1", 1), ("r:A2", 1)]
    arcs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), (None, "z"), ("l", "l")], "x string, y string")
    assert rows(walk.components(arcs)) == [("a", "a"), ("b", "a"), ("c", "a"), ("l", "l"), ("x", "x"), ("y", "x")]
    assert rows(walk.on_loops(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("e", "a")], "x string, y string"))) == [("a",), ("b",)]
    links = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "node string, found_by string")
    assert rows(walk.chain_to_root(links, "c")) == [(0, "c"), (1, "b"), (2, "a")]


def test_long_chain_components(spark):
    arcs = spark.createDataFrame([(f"{k:04}", f"{k + 1:04}") for k in range(300)], "x string, y string")
    assert {r["component"] for r in walk.components(arcs).collect()} == {"0000"}


def test_documents(spark):
    items = spark.createDataFrame([("term", "d1", "p1"), ("term", "d2", "p2"), ("term", "d2", "p3"), ("only", "d1", "p1"), (None, "d1", "p1")], "concept string, doc string, provision string")
    assert rows(docs.overlaps(items), "concept", "n_docs", "n_provisions") == [("term", 2, 3)]
    assert rows(docs.compare_documents(items, "d1", "d2")) == [("only", "a"), ("term", "shared")]
    pairs = spark.createDataFrame([("I", "II"), ("I", "II"), ("II", "I"), ("I", "I")], "source string, target string")
    assert rows(docs.reference_matrix(pairs)) == [("I", 0, 2), ("II", 1, 0)]
    assert rows(docs.matrix_margins(pairs)) == [("I", 2, 1), ("II", 1, 2)]
    a, b = (spark.createDataFrame(x, "k string, v string") for x in ([("1", "x"), ("2", "y"), ("3", None)], [("2", "z"), ("3", None), ("4", "w")]))
    assert rows(docs.keyed_diff(a, b, ["k"], "v")) == [("1", "removed", "x", None), ("2", "modified", "y", "z"), ("4", "added", None, "w")]


def test_versions(spark):
    t = lambda m: datetime(2023, m, 1)
    v = spark.createDataFrame([("A17", 1, t(1), t(6), "superseded"), ("A17", 2, t(6), t(12), "superseded"), ("A17", 3, t(12), None, "active"), ("A18", 1, t(3), None, "active")], "subject string, version int, valid_from timestamp_ntz, valid_until timestamp_ntz, status string")
    at = lambda m: F.lit(t(m)).cast("timestamp_ntz")
    assert rows(ver.versions_at(v, at(6)), "subject", "version") == [("A17", 2), ("A18", 1)]
    assert rows(ver.versions_at(v, at(2)), "subject", "version") == [("A17", 1)]
    assert rows(ver.changes_between(v, at(1), at(6)), "subject", "version", "change", "previous") == [("A17", 2, "modified", 1), ("A18", 1, "added", None)]
    r = spark.createDataFrame([("A17",), ("A18",), ("other",)], "x string")
    assert rows(ver.as_of(r, v, at(2), ["x"]), "x") == [("A17",), ("other",)]
    e = spark.createDataFrame([("A17", t(7)), ("A18", t(1)), ("A17", t(7))], "s string, at timestamp_ntz")
    assert rows(ver.as_of_join(e, v, "s", "at"), "s", "version") == sorted([("A17", 2), ("A17", 2), ("A18", None)], key=str)
    assert rows(ver.durations(v), "subject", "seconds") == [("A17", 334 * 86400)]
    triples = spark.createDataFrame([("v1", "title", "a"), ("v2", "title", "b"), ("v1", "old", "x"), ("v2", "new", "y"), ("v1", "same", "s"), ("v2", "same", "s")], "s string, p string, o string")
    assert rows(ver.compare_versions(triples, "v1", "v2")) == [("new", "added", None, "y"), ("old", "removed", "x", None), ("title", "modified", "a", "b")]


def test_votes(spark):
    v = spark.createDataFrame([(f"v{k}", "t", w, "for" if w != "c" else "against") for k in range(6) for w in "abc"] + [("v7", "u", "a", "against"), ("v8", "u", "a", "for")], "vote string, topic string, voter string, position string")
    assert rows(voting.coalitions(v, 0.8)) == [("a", "b", 6, 6, 1.0)]
    assert rows(voting.swing_voters(v)) == [("a", 2, 1, 0.5)]
    assert rows(voting.consistent_opponents(v)) == [("c", "t", 6, 6, 1.0)]
    assert rows(voting.topic_clusters(v)) == [("t", 6, 6, 0, 0), ("u", 2, 1, 1, 0)]
    assert rows(voting.voter_profiles(v.filter("voter = 'a'"))) == [("a", 8, 7, 1, 0, 0)]


def test_votes_of_many_pairs(spark, monkeypatch):
    """Pairs that are many times the rows are not shuffled: voters are counted in blocks, with the results of a join."""
    draw = random.Random(3)
    cast = [(f"v{k}" if k else None, f"w{w:02}" if w else None, draw.choice(["for", "against", "abstain", None])) for k in range(30) for w in range(60) for _ in range(draw.choice([0, 1, 1, 2 if w % 7 else 0]))]
    last, total = {}, Counter(w for _, w, _ in cast)
    for v, w, p in cast:
        last[v, w] = max(last.get((v, w), ""), p or "")
    want = []
    for a, b in itertools.combinations(sorted(w for w in total if w), 2):
        same, n = sum(1 for k in range(1, 30) if last.get((f"v{k}", a)) and last.get((f"v{k}", a)) == last.get((f"v{k}", b))), min(total[a], total[b])
        if n >= 20 and same and same / n >= 0.25:
            want.append((a, b, same, n, same / n))
    assert 50 < len(want) < 500
    v = spark.createDataFrame(cast, "vote string, voter string, position string")
    out = voting.coalitions(v, 0.25, 20)
    assert "hashpartitioning(voter_a" not in out._jdf.queryExecution().toString()
    assert rows(out) == want
    monkeypatch.setattr(voting, "_PER_TASK", 1000)
    assert rows(voting.coalitions(v, 0.25, 20)) == want
    assert [r[:3] for r in rows(voting.coalitions(v, -1.0, 0))] == [r[:3] for r in _joined_votes(voting, v, monkeypatch)]
    assert rows(voting.coalitions(v.limit(0))) == []


def test_pairs_of_blocks_follow_each_other(spark, monkeypatch):
    """Equal values of the pairs counted in blocks follow each other, so files of many pairs are small; places need two bytes where they fit."""
    draw = random.Random(5)
    cast = [(f"v{k}", w, draw.choice(["for", "against"])) for w in range(300) for k in draw.sample(range(60), 20 + w % 23)]
    v = spark.createDataFrame(cast, "vote string, voter long, position string")
    monkeypatch.setattr(voting, "_JOINED", 0)
    want = None
    for per_task, short in ((1 << 28, 1 << 15), (60_000, 1 << 15), (60_000, 1)):
        monkeypatch.setattr(voting, "_PER_TASK", per_task)
        monkeypatch.setattr(voting, "_SHORT", short, raising=False)
        out = voting.coalitions(v, 0.2)
        got = [tuple(r) for r in out.collect()]
        assert len(got) > 10_000 and len(set(got)) == len(got)
        assert len(list(itertools.groupby(got, lambda r: r[2:]))) < len(got) / 4
        assert sum(1 for x, y in itertools.pairwise(got) if x[0] != y[0] and x[1] != y[1]) < len(got) / 4
        want = want or set(got)
        assert set(got) == want
        assert ("array<smallint>" in out._jdf.queryExecution().toString()) == (short > 1)
    monkeypatch.setattr(voting, "_JOINED", 1e9)
    assert {tuple(r) for r in voting.coalitions(v, 0.2).collect()} == want


def test_rows_sorted_by_one_number_or_by_three():
    draw = np.random.default_rng(2)
    for most in ((200, 3, 200), (1 << 31, 1 << 20, 1 << 31), (1, 1, 1)):
        x = [draw.integers(0, m, 500).astype(np.min_scalar_type(m)) for m in most]
        assert list(zip(*(y.tolist() for y in voting._sorted(*x)))) == sorted(zip(*(y.tolist() for y in x)))
    assert [len(y) for y in voting._sorted(*(y[:0] for y in x))] == [0, 0, 0]


def test_least_number_of_shared_positions():
    """The whole number by which pairs are kept is where the quotient of the result reaches the threshold, exactly."""
    n = np.arange(1, 2000)
    for threshold in (0.05, 0.1, 0.3, 1 / 3, 0.8, 0.07, 1.0, 0.0):
        k = voting._needed(n, threshold)
        assert (k / n >= threshold).all() and ((k == 1) | ((k - 1) / n < threshold)).all() and (np.diff(k) >= 0).all()


def _joined_votes(voting, v, monkeypatch):
    monkeypatch.setattr(voting, "_JOINED", 1e9)
    return rows(voting.coalitions(v, -1.0, 0))


def test_functions(spark):
    df = spark.createDataFrame([("IV", "<p>A &amp; B<br>C</p><script>x</script>", "The  Dr. X", "25 May 2018", "https://www.A.org/x", "Personal Data!", "r:GDPR:Art17(1)")], "r string, h string, n string, d string, u string, t string, a string")
    got = df.select(fn.roman_value(F.col("r")), fn.html_text(F.col("h")), fn.plain_name(F.col("n")), fn.day(F.col("d")).cast("string"), fn.domain(F.col("u")), fn.slug(F.col("t")), fn.article_number(F.col("a"))).collect()[0]
    assert tuple(got) == (4, "A & B\nC", "Dr. X", "2018-05-25", "a.org", "personal_data", 17)
    s = spark.createDataFrame([("a b c", "a b d"), ("", None), ("a", "")], "x string, y string")
    assert [r[0] for r in s.select(fn.word_similarity(F.col("x"), F.col("y"))).collect()] == [50, 100, 0]
    assert [r[0] for r in spark.createDataFrame([("IIX",), ("",), (None,), ("MCMXC",)], "r string").select(fn.roman_value(F.col("r"))).collect()] == [None, None, None, 1990]


LAW = """REGULATION
CHAPTER I
General provisions
Article 1
Scope
The controller shall keep records under Article 2(1)(a) and Regulation (EU) 2016/679.
Article 2
Terms
(1) 'personal data' means any information;
CHAPTER II
Article 3
Rights
The data subject has the right to object, and may not be charged. See Articles 1 to 2."""


def test_extraction(spark):
    d = spark.createDataFrame([(1, LAW, "R"), (2, None, "R"), (3, "", "R")], "doc_id long, text string, base string")
    assert rows(ex.references(d), "target", "identifier") == sorted([("article", "article:2/1/a"), ("regulation", "regulation:2016/679"), ("articles", "articles:1/2"), ("chapter", "chapter:I"), ("chapter", "chapter:II"), ("article", "article:1"), ("article", "article:2"), ("article", "article:3")], key=str)
    for r in ex.references(d).collect():
        assert LAW[r["start"] : r["end"]] == r["matched"]
    assert rows(ex.norms(d), "kind", "verb") == [("obligation", "keep"), ("prohibition", "be"), ("right", "object")]
    assert rows(ex.definitions(d), "number", "term", "definition") == [("1", "personal data", "any information;")]
    p = rows(ex.provisions(d), "line", "chapter", "article")
    assert ("Scope", "I", "1") in p and ("Rights", "II", "3") in p and ("CHAPTER II", "II", None) in p and ("REGULATION", None, None) in p
    t = rows(ex.provision_triples(d, F.col("base")))
    assert ("R:Art1", "reg:references", "R:Art2") in t and ("R:Art3", "reg:partOf", "R:ChapterII") in t and ("R:Art2", "reg:defines", "personal data") in t and ("R:Art1", "reg:title", "Scope") in t
    terms = spark.createDataFrame([("data subject",), ("Record",), (None,)], "term string")
    assert rows(ex.term_usage(d, terms), "term", "n") == [("data subject", 1), ("record", 1)]
    assert rows(ex.keyword_search(d, ["controller"], ["records"])) == [(1, 12)]
    bill = spark.createDataFrame([(1, 'Section 2 is amended by striking "a" and inserting "b". Section 3 is repealed.')], "doc_id long, text string")
    assert rows(ex.amendments(bill), "kind", "old", "new") == [("repeal", None, None), ("strike_insert", "a", "b")]
    q = spark.createDataFrame([(1, "as in force on 3 May 2011, as amended by Act 5.")], "doc_id long, text string")
    assert rows(ex.temporal_qualifiers(q), "kind", "detail") == [("amended", "Act 5"), ("in_force_on", "3 May 2011")]


def test_line_diff(spark):
    assert ex.line_diff(["a", "b", "c"], ["a", "c", "d"]) == [("=", "a"), ("-", "b"), ("=", "c"), ("+", "d")]
    assert ex.line_diff([], []) == []
    p = spark.createDataFrame([(1, "a\nb", "b"), (2, None, "x"), (3, None, None)], "k long, a string, b string")
    assert rows(ex.text_diffs(p, "k", "a", "b")) == [(1, 0, "-", "a"), (1, 1, "=", "b"), (2, 0, "+", "x")]


def test_rdf_forms(spark, g, tmp_path):
    lines = [r[0] for r in rdf.ntriples(g.triples).collect()]
    assert '<r:A3> <reg:title> "Erasure \\"now\\"" .' in lines
    (tmp_path / "x.nt").write_text("\n".join(lines) + "\n# comment\n")
    assert rows(rdf.read_ntriples(spark, str(tmp_path / "x.nt"))) == rows(g.triples)
    block = rdf.turtle(g.triples).filter("s = 'r:A3'").collect()[0]["block"]
    assert block.startswith("r:A3\n    a reg:Article ;") and block.endswith(" .\n")
    node = json.loads(rdf.jsonld(g.triples).filter("s = 'r:A3'").collect()[0]["json"])
    assert node["@id"] == "r:A3" and node["@type"] == "reg:Article" and node["reg:title"] == 'Erasure "now"'
    assert "&quot;now&quot;" in rdf.rdfxml(g.triples).filter("s = 'r:A3'").collect()[0]["block"]
    rdf.write_json_triples(g.triples, str(tmp_path / "j"))
    assert rows(rdf.read_json_triples(spark, str(tmp_path / "j"))) == rows(g.triples)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Title one\nbody")
    assert rows(files.read_texts(spark, str(tmp_path / "a.txt")), "title") == [("Title one",)]
    (tmp_path / "a.html").write_text("<html><title>T</title><body><p>One</p><p>Two</p></body></html>")
    assert rows(files.read_html(spark, str(tmp_path / "a.html")), "title") == [("T",)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.txt", "hello")
    assert [(r["member"], bytes(r["content"])) for r in files.read_archives(spark, str(tmp_path)).collect()] == [("in/x.txt", b"hello")]
    (tmp_path / "v.xml").write_text("<votes><vote><id>1</id><member><name>A</name></member></vote><vote><id>2</id></vote></votes>")
    assert rows(files.read_xml(spark, str(tmp_path / "v.xml"), "vote", "id long"), "id") == [(1,), (2,)]
    d = spark.createDataFrame([(1, "regu-\nlation\n12\nend")], "doc_id long, text string")
    assert rows(files.preprocess_lines(d)) == [(1, "regulation\nend")]


def test_library(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    t = spark.createDataFrame([("s", "p", "o", "d1"), ("s", "p", "o", "d1"), ("s", "q", "o", "d2")], "s string, p string, o string, doc string")
    lib.add(t, "EU", "eu", ["x"])
    assert rows(lib.documents(), "doc", "n_triples", "status") == [("d1", 1, "ready"), ("d2", 1, "ready")]
    lib.add(spark.createDataFrame([("s", "p", "new", "d1")], t.schema))
    assert rows(lib.load(["d1"]), "o") == [("new",)] and lib.graph().triples.count() == 2
    lib.remove("d2")
    assert rows(lib.load(), "doc") == [("d1",)]
    assert (None, None, 1, 1) in rows(lib.stats())


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    stream = watch.watch_files(spark, str(src))
    watch.run_once(stream.select("path", "checksum"), str(tmp_path / "out"), str(tmp_path / "state"))
    (src / "b.txt").write_text("two")
    watch.run_once(watch.watch_files(spark, str(src)).select("path", "checksum"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2  # each file once, over a restart
    log = tmp_path / "log"
    spark.createDataFrame([("p", "1"), ("q", "1")], "path string, checksum string").write.parquet(str(log))
    spark.createDataFrame([("p", "2"), ("q", "1")], "path string, checksum string").write.mode("append").parquet(str(log))
    got = watch.changed(watch.watch_table(spark, str(log), "path string, checksum string", per_trigger=1))
    watch.run_once(got, str(tmp_path / "changes"), str(tmp_path / "state2"))
    n = spark.read.parquet(str(tmp_path / "changes"))
    assert n.filter("path = 'q'").count() == 1 and n.filter("path = 'p'").count() == 2
    d = spark.createDataFrame([("A safety rule", "x", datetime(2020, 1, 1)), ("Other", "y", None)], "title string, category string, published_at timestamp")
    assert rows(watch.filter_documents(d, title_contains="SAFETY", since="2019-01-01"), "category") == [("x",)]


def test_triples_of_all_languages(spark, tmp_path):
    from normgraph.queries_text import e_triples

    spark.createDataFrame([(k, LAW, lang) for k, lang in enumerate(("en", None, "und", "de"))], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    t = rows(e_triples(spark, str(tmp_path)))
    assert all((f"doc:{k}:Art1", "reg:references", f"doc:{k}:Art2") in t for k in range(4))

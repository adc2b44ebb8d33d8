"""Named graphs, version logs, activity, formats, running queries, the library and scalar functions on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from normgraph.__main__ import main
from normgraph.functions import text as fn
from normgraph.operators import activity as act
from normgraph.operators import temporal as tm
from normgraph.operators import traversal as walk
from normgraph.operators import versions as ver
from normgraph.operators.graph import TripleGraph
from normgraph.plans import running
from normgraph.sources import rdf
from normgraph.sources.library import Library
from normgraph.sources.registry import Formats
from tests.conftest import rows

T = lambda d: dt.datetime(2020, 1, d)


def test_named_graphs(spark):
    log = spark.createDataFrame([("a", T(1), T(9), False, T(1)), ("b", None, None, False, T(1)), ("b", None, None, True, T(2)), ("c", T(5), None, None, T(1))], "name string, valid_from timestamp, valid_until timestamp, is_deleted boolean, at timestamp")
    quads = spark.createDataFrame([("x", "p", "1", None), ("x", "p", "2", "a"), ("x", "p", "3", "b"), ("x", "p", "4", "c"), ("x", "p", "1", "a"), ("x", "p", None, "a")], "s string, p string, o string, g string")
    assert rows(tm.graph_list(log), "name") == [("a",), ("c",)]
    assert rows(tm.graph_triples(quads, log, "a").triples, "o") == [("1",), ("2",)] and rows(tm.graph_triples(quads, log).triples, "o") == [("1",)] and tm.graph_triples(quads, log, "b").triples.count() == 0
    at = lambda d: rows(tm.triples_at(quads.dropna(subset="o"), log, F.lit(T(d))), "o")
    assert at(1) == [("1",), ("2",)] and at(9) == [("1",), ("4",)] and at(6) == [("1",), ("2",), ("4",)]
    assert rows(tm.graph_stats(quads.dropna(subset="o"), log)) == [("", 1), ("a", 2), ("c", 1)]
    assert tm.graph_list(log.limit(0)).count() == 0 and tm.graph_stats(quads.limit(0), log.limit(0)).count() == 0


def test_version_log(spark):
    log = [(T(1), "s", "1", "add", None, T(1)), (T(2), "s", "2", "add", None, T(4)), (T(2), "s", "1", "supersede", "2", T(4)), (T(2), "s", "2", "link", "1", None), (T(3), "s", "2", "status", "draft", None), (T(4), "s", "2", "status", "active", None), (T(4), "t", "1", "status", "draft", None)]
    v = tm.version_state(spark.createDataFrame(log, "at timestamp, subject string, version string, action string, value string, when timestamp"))
    assert rows(v, "subject", "version", "status", "previous", "next") == [("s", "1", "superseded", None, "2"), ("s", "2", "active", "1", None)]
    assert [r["version"] for r in tm.in_force(v, F.lit(T(5))).collect()] == ["2"] and tm.in_force(v, F.lit(T(2))).count() == 0


def test_as_of_join_of_overlapping_and_hot_subjects(spark):
    versions = [("a", 1, T(1), T(5)), ("a", 2, T(5), None), ("b", 1, T(1), None), ("b", 2, T(3), T(4)), ("c", 1, T(2), T(3)), ("c", 2, T(6), T(8))]
    v = spark.createDataFrame(versions, "subject string, version long, valid_from timestamp, valid_until timestamp")
    events = [(s, d) for s in ("a", "b", "c", "z") for d in range(1, 12)] + [("a", 2)] * 3
    e = spark.createDataFrame([(k, s, T(d)) for k, (s, d) in enumerate(events)] + [(99, "a", None), (98, None, T(1))], "id long, s string, at timestamp")

    def want(s, at):
        held = [(f, n) for x, n, f, u in versions if x == s and at and f <= at and (u is None or at < u)]
        return max(held)[1] if held else None

    got = {r["id"]: r["version"] for r in ver.as_of_join(e, v, "s", "at").collect()}
    assert got == {k: want(s, T(d)) for k, (s, d) in enumerate(events)} | {99: None, 98: None}
    assert ver.as_of_join(e, v.limit(0), "s", "at").filter("version is not null").count() == 0 and ver.as_of_join(e.limit(0), v, "s", "at").count() == 0


def test_overlaps_of_a_crowd(spark):
    day = lambda d: dt.date(2020, 1, d)
    data = [(k, "x" if k < 20 else "y", day(1 + k % 9), day(1 + k % 9 + k % 3) if k % 5 else None) for k in range(24)]
    df = spark.createDataFrame(data, "id long, k string, start_date date, end_date date")
    want = sorted(((a[0], b[0]) for a in data for b in data if a[1] == b[1] and a[2] <= (b[3] or day(31)) and b[2] <= (a[3] or day(31))), key=str)
    for crowd in (3, 2000):
        assert rows(ver.overlapping(df, df, ["k"], crowd=crowd), "id", "b_id") == want


def test_loops(spark):
    arcs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g"), ("h", "i"), (None, "a"), ("a", "b"), ("x", "a"), ("m", "n"), ("n", "o"), ("o", "m"), ("o", "n")]
    df = spark.createDataFrame(arcs, "x string, y string")
    assert rows(walk.loops(df)) == [("a", "c"), ("b", "c"), ("c", "c"), ("d", "e"), ("e", "e"), ("g", "g"), ("m", "o"), ("n", "o"), ("o", "o")]
    assert walk.loops(df.limit(0)).count() == 0


def test_activity(spark):
    items = spark.createDataFrame([(1, dt.date(2020, 1, 1), "open"), (2, dt.date(2020, 1, 1), "Completed "), (3, dt.date(2020, 1, 14), None), (4, None, "open")], "id long, due date, status string")
    assert rows(act.overdue(items, "due", "status", F.lit(dt.date(2020, 1, 20))), "id", "days_over") == [(1, 19)]
    work = spark.createDataFrame([("a", "open"), ("b", "done"), ("c", None)], "item string, state string")
    links = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c"), ("x", "a"), ("y", "b"), (None, "a")], "item string, on string")
    assert rows(act.blocked(work, links, F.col("state") == "done")) == [("x", 2)]
    text = "Action: Ms. Rulo to send the text by 3 May 2021\nAction item: done by 2021-06-01\nAction: Ms. Rulo to send the text by 3 May 2021\nMs. Rulo met Dr. Kodo Lisa.\nFor: A, B. C\nAgainst: D"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["task"]: (r["assignee"], r["due"], r["is_open"]) for r in act.actions(docs).collect()}
    assert got == {"Ms. Rulo to send the text by 3 May 2021": ("Ms. Rulo", dt.date(2021, 5, 3), True), "done by 2021-06-01": (None, dt.date(2021, 6, 1), False)}
    assert rows(act.speakers(docs), "name", "title", "n") == [("Kodo Lisa", "Dr", 1), ("Rulo", "Ms", 3)]
    assert rows(act.roll_calls(docs), "voter", "position") == [("A", "for"), ("B. C", "for"), ("D", "against")]
    dates = spark.createDataFrame([(1, "It takes effect on 3 May 2021 and expires on May 4, 2022; it applies retroactively to 1 June 2019.")], "doc_id long, text string")
    assert rows(act.effective_dates(dates), "kind", "date") == sorted([("effective", dt.date(2021, 5, 3)), ("sunset", dt.date(2022, 5, 4)), ("retroactive", dt.date(2019, 6, 1))], key=str)
    agenda = spark.createDataFrame([("i", "Amendment of Article 5 and Article 6"), ("j", None)], "item string, title string")
    known = spark.createDataFrame([("R:Art5", "5"), ("R:Art6", "6"), ("S:Art6", "6")], "uri string, article string")
    assert rows(act.linked_provisions(agenda, known, "item", "title")) == [("i", "article:5", "R:Art5", 1.0), ("i", "article:6", "R:Art6", 0.5)]
    labels = spark.createDataFrame([("u1", "levy"), ("u2", "Levy on x"), ("u3", "the levy"), ("u4", "fee")], "s string, label string")
    assert [(r["s"], r["rank"]) for r in act.node_search(labels, "levy").collect()] == [("u1", 0), ("u2", 1), ("u3", 2)]


def test_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "reg", "jurisdiction": "EU", "required": [["Article \\d+", 1]], "negative": [["Present:", 1]]}))
    (tmp_path / "b.json").write_text(json.dumps({"jurisdiction": "us", "required": [["Article \\d+", 1], ["Sec\\.", 1]]}))
    f = Formats.load(str(tmp_path))
    assert sorted(f) == ["b", "reg"] and f.of("eu") == ["reg"] and f.of("x") == []
    docs = spark.createDataFrame([(1, "Article 1"), (2, "Article 1 Sec. 2"), (3, None), (4, "nothing")], "doc_id long, text string")
    assert rows(f.detect(docs)) == [(1, "reg", 1.0), (2, "b", 1.0)]
    with pytest.raises(ValueError):
        Formats({"x": {"required": []}})


def test_running_with_measures_and_a_limit(spark):
    g = TripleGraph.of(spark, [("a", "p", "b"), ("b", "p", "c")])
    df, m = running.run(g, "SELECT ?x ?z WHERE { ?x p ?y . ?y p ?z }")
    assert rows(df) == [("a", "c")] and m.rows == 1 and m.patterns == 2 and m.total >= m.execute > 0
    many = spark.range(2000).select(F.lit("p").alias("p"), F.col("id").cast("string").alias("s"), F.lit("o").alias("o"))
    with pytest.raises(running.QueryTimeout):
        running.run(TripleGraph(many), "SELECT ?a ?b ?c WHERE { ?a p ?x . ?b p ?x . ?c p ?x . FILTER(?a < ?b) }", seconds=0.5)
    assert running.run(g, "SELECT ?x WHERE { ?x p c }")[1].rows == 1


def test_library_keeps_texts_and_failures(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    docs = spark.createDataFrame([("d1", "x"), ("d2", "y"), ("d2", "y"), (None, "z")], "doc string, text string")
    make = lambda d: d.select(F.concat("doc", F.lit(":1")).alias("s"), F.lit("p").alias("p"), F.col("text").alias("o"), "doc")
    lib.ingest(docs, make)
    assert rows(lib.texts(), "doc", "text") == [("d1", "x"), ("d2", "y")] and rows(lib.documents(), "doc", "status", "n_triples") == [("d1", "ready", 1), ("d2", "ready", 1)]
    lib.ingest(docs.withColumn("text", F.lit("new")), make)
    assert rows(lib.texts("d1"), "text") == [("x",)]
    lib.ingest(docs.withColumn("text", F.lit("new")), make, force=True)
    assert rows(lib.texts("d1"), "text") == [("new",)] and rows(lib.load(("d1",)), "o") == [("new",)]
    with pytest.raises(ValueError):
        lib.ingest(spark.createDataFrame([("d3", "x")], "doc string, text string"), lambda d: 1 / 0 if d is None else (_ for _ in ()).throw(ValueError()))
    assert ("d3", "failed") in rows(lib.documents(), "doc", "status")


def test_turtle_with_prefixes(spark):
    t = spark.createDataFrame([("http://purl.org/dc/terms/x", "http://www.w3.org/2000/01/rdf-schema#label", "y")], "s string, p string, o string")
    assert rdf.turtle(t).first()["block"] == 'dc:x\n    rdfs:label "y" .\n'


def test_functions(spark):
    one = spark.createDataFrame([(1,)], "x long")
    value = lambda c: one.select(c.alias("v")).first()["v"]
    base = F.lit(dt.date(2020, 2, 28))
    assert [value(fn.relative_day(F.lit(t), base)) for t in ("today", "Tomorrow", "in 2 weeks", "3 days ago", "one day")] == [dt.date(2020, 2, 28), dt.date(2020, 2, 29), dt.date(2020, 3, 13), dt.date(2020, 2, 25), None]
    assert value(fn.snippet(F.lit("a" * 60 + " shall " + "b" * 60), F.lit(61), F.lit(66), 4)) == "…aaa shall bbb…" and value(fn.snippet(F.lit("x shall"), F.lit(2), F.lit(7))) == "x shall"
    assert [value(fn.bytes_text(F.lit(n))) for n in (0, 1023, 1536, 3 * 1024**3)] == ["0 B", "1023 B", "1.5 KB", "3.0 GB"] and value(fn.thousands(F.lit(1234567))) == "1,234,567"
    assert [value(fn.seconds_text(F.lit(n))) for n in (5, 65, 3605)] == ["5s", "1m 05s", "1h 00m 05s"]
    df = spark.createDataFrame([("10",), ("9a",), ("x",), ("9",)], "c string")
    assert [r["c"] for r in df.orderBy(fn.clause_order(F.col("c"))).collect()] == ["9", "9a", "10", "x"]


def test_command_line_on_texts_and_libraries(spark, tmp_path, capsys):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("See Article 5 of Regulation (EU) 2016/679 on the levy.")
    assert main(["refs", str(tmp_path / "t"), "--form", "csv"]) == 0 and "article:5/2016/679" in capsys.readouterr().out
    assert main(["search", str(tmp_path / "t"), "levy", "--form", "csv"]) == 0 and '"10"' in capsys.readouterr().out
    lib = Library(spark, str(tmp_path / "lib"))
    lib.add(spark.createDataFrame([("a", "p", "b", "d1")], "s string, p string, o string, doc string"))
    assert main(["library", "list", str(tmp_path / "lib"), "--form", "csv"]) == 0 and "d1" in capsys.readouterr().out
    assert main(["library", "query", str(tmp_path / "lib"), "SELECT ?x WHERE { ?x p b }", "--form", "csv"]) == 0 and '"a"' in capsys.readouterr().out


USLM = """<?xml version="1.0"?><uscDoc><meta>x</meta><title><num>TITLE 5</num><heading>ORGANIZATION</heading>
<section><num>§ 101.</num><heading>Executive departments</heading><content><p>The &amp; departments are:</p></content></section></title></uscDoc>"""
AKN = """<akomaNtoso xmlns="http://x"><act><meta><FRBRalias value="A/1"/></meta><body><paragraph eId="p1"><num>1.</num><content><p>Decides to <b>act</b>;</p></content></paragraph>
<paragraph><num>2.</num><p>Requests more.</p></paragraph></body></act></akomaNtoso>"""


def test_bulk_sources(spark, tmp_path):
    from normgraph.sources import bulk, connectors

    one = spark.createDataFrame([(USLM,), (None,), ("",)], "x string").select(bulk.code_text(F.col("x")).alias("t"))
    assert rows(one.filter("t <> ''")) == [("TITLE 5 ORGANIZATION\n§ 101. Executive departments\nThe & departments are:",)]
    (tmp_path / "r.xml").write_text(AKN)
    (tmp_path / "s.xml").write_text("<a/>")
    p = bulk.akoma_ntoso(spark, str(tmp_path / "*.xml"))
    assert rows(p) == [("A/1", 1, "Decides to act ;"), ("A/1", 2, "Requests more.")]
    assert ("urn:resolution:A/1#2", "reg:actionVerb", "requests") in rows(connectors.resolution_triples(p))
    lib = Library(spark, str(tmp_path / "lib"))
    make = lambda d: d.select(F.col("doc").alias("s"), F.lit("p").alias("p"), F.col("text").alias("o"), "doc")
    down = spark.createDataFrame([("usc", "d1", "Title 5", "a.xml", USLM), ("usc", "d2", "Other", "b.txt", "x"), ("cfr", "d3", "title 7", "c.html", "<p></p>"), ("cfr", "d4", None, "e.txt", "x")], "source string, doc string, title string, name string, content string")
    assert rows(bulk.ingest_downloads(lib, down, make, "title")) == [("cfr", "empty", 1), ("cfr", "filtered", 1), ("usc", "filtered", 1), ("usc", "ingested", 1)]
    assert rows(bulk.ingest_downloads(lib, down, make, "title"), "source", "status") == [("cfr", "empty"), ("cfr", "filtered"), ("usc", "filtered"), ("usc", "present")]
    assert rows(lib.documents(), "doc", "status") == [("d1", "ready")]


def test_ages_and_deletions(spark):
    from normgraph.streaming import watch

    docs = spark.createDataFrame([("a", 1), ("b", 10), ("c", None)], "path string, days int").withColumn("published_at", F.current_timestamp() - F.make_interval(days=F.col("days")))
    assert rows(watch.filter_documents(docs, oldest="5 days"), "path") == [("a",)] and rows(watch.filter_documents(docs, youngest="5 days"), "path") == [("b",)]
    assert rows(watch.deleted(docs, docs.filter("path <> 'b'"))) == [("b",)]


def test_narrowing_and_orphans(spark):
    from normgraph.operators import minutes as mi

    pairs = spark.createDataFrame([(1, "may apply", "may apply unless refused, subject to fees"), (2, "may apply Unless refused", "may apply"), (3, None, None), (4, "x", "y")], "id long, before string, after string")
    assert rows(mi.narrowed(pairs, ("id",))) == [(1, "subject to, unless", "narrowing"), (2, "", "expansion")]
    refs = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("a", "t1")], "source string, target string")
    gone = spark.createDataFrame([("t1", "repeal"), ("t2", "replace")], "target string, kind string")
    assert rows(mi.orphaned(gone, refs)) == [("t1", "a")]

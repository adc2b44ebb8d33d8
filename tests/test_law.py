"""Resolution, matching, citations, minutes, bills, connectors and the command line on small fixtures."""

from datetime import datetime

from pyspark.sql import functions as F

from normgraph.__main__ import main
from normgraph.operators import citations as cit
from normgraph.operators import minutes as mi
from normgraph.operators import resolution as res
from normgraph.sources import connectors as con
from tests.conftest import rows


def test_paragraphs(spark):
    d = spark.createDataFrame([(1, "intro\n1. First:\n(a) one;\n(b) two\nmore two\n2. Second under point\n(a) of paragraph 1 holds.\n"), (2, None)], "id long, body string")
    assert rows(res.split_paragraphs(d, "id", "body")) == sorted([(1, None, None, "intro"), (1, "1", None, "1. First:"), (1, "1", "a", "(a) one;"), (1, "1", "b", "(b) two\nmore two"), (1, "2", None, "2. Second under point\n(a) of paragraph 1 holds.")], key=str)


def test_resolution(spark):
    there = spark.createDataFrame([("d", "1", None, None), ("d", "2", "1", None), ("d", "2", "1", "a"), ("d", "3", None, None), ("e", "9", None, None)], "doc string, article string, paragraph string, point string")
    refs = spark.createDataFrame([("d", "1", "internal", "article", i) for i in ("article:2/1/a", "article:2/1", "article:2/7", "article:1", "article:9", "article:3")] + [("d", None, "internal", "articles", "articles:1/3"), ("d", "1", "internal", "articles", "articles:3/5"), ("d", "1", "external", "directive", "directive:95/46"), ("d", "1", "internal", "point", "point:a")], "doc string, source_article string, kind string, target string, identifier string")
    got = {r["identifier"]: (r["status"], r["confidence"], r["targets"]) for r in res.resolve_references(refs, there).collect()}
    assert got == {"article:2/1/a": ("resolved", 1.0, [2]), "article:2/1": ("resolved", 1.0, [2]), "article:2/7": ("partial", 0.75, [2]), "article:1": ("self_ref", 1.0, [1]), "article:9": ("not_found", 0.0, []), "article:3": ("resolved", 1.0, [3]), "articles:1/3": ("range_ref", 1.0, [1, 2, 3]), "articles:3/5": ("range_ref", 0.75, [3]), "directive:95/46": ("external", 1.0, []), "point:a": ("not_found", 0.0, [])}
    r = res.resolution_report(res.resolve_references(refs, there)).collect()[0]
    assert (r["n"], r["n_resolved"], r["n_range"], round(r["rate"], 3)) == (10, 3, 2, round(6 / 9, 3))


def test_mentions(spark):
    m = spark.createDataFrame([("working group b",), ("The Budget Panel",), ("nobody",), (None,)], "mention string")
    a = spark.createDataFrame([("e1", "Working Group B"), ("e2", "Working Group A"), ("e3", "Budget Panel"), (None, "x"), ("e4", None)], "entity string, alias string")
    assert rows(res.match_mentions(m, a, 0.6)) == [("The Budget Panel", "e3", 2 / 3), ("working group b", "e1", 1.0)]


def test_scenarios(spark):
    p = spark.createDataFrame([("A7", "withdraw consent at any time"), ("A17", "erasure"), ("A6", "lawful consent"), ("A99", "force")], "id string, text string")
    r = spark.createDataFrame([("A17", "A7"), ("A7", "A6")], "source string, target string")
    got = rows(res.scenario_matches(p, r, spark.createDataFrame([("A7", 0.9)], "id string, score double"), spark.createDataFrame([("consent",), ("withdraw",)], "word string")))
    assert [(a, b, round(c, 2)) for a, b, c in got] == [("A17", "triggered", 0.7), ("A6", "triggered", 0.65), ("A7", "direct", 1.0)]


def test_citations(spark):
    text = "Under Regulation (EU) 2016/679, Directive 95/46/EC, Article 16 TFEU, 42 U.S.C. § 1983, 45 CFR Part 164, Public Law 104-191, the Data Protection Act 2018 and [2019] UKSC 41."
    c = cit.with_identifiers(cit.citations(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")))
    got = {r["type"]: r for r in c.collect() if r["type"] != "case"}
    assert got["regulation"]["urn"] == "urn:eu:regulation:2016/679" and got["regulation"]["address"].endswith("CELEX:32016R0679")
    assert got["directive"]["address"].endswith("CELEX:31995L0046") and got["usc"]["urn"] == "urn:us:usc:42/1983" and got["cfr"]["address"].endswith("title-45/part-164")
    assert got["public_law"]["urn"] == "urn:us:pl:104-191" and got["treaty"]["urn"] == "urn:eu:treaty:tfeu/16" and got["act"]["urn"].endswith("/2018")
    for r in c.collect():
        assert text[r["start"] : r["end"]] == r["matched"]
    spans = sorted((r["start"], r["end"]) for r in c.collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


MINUTES = """Date: 3 May 2011
Chair: Ms. A. Kahido
Present: X, Y
1. Opening of the session
Mr. Sojaju (Zushini): We support the text.
It was decided that the levy stays.
Action: Secretariat to report.
The motion had 12 votes in favour, 3 against and 2 abstentions."""


def test_wide_ranges(spark):
    there = spark.createDataFrame([(1, str(k), None, None) for k in (1, 2, 900, 1500)] + [(2, "5000", None, None)], "doc long, article string, paragraph string, point string")
    refs = spark.createDataFrame([(1, "1", "range", "articles", "articles:1/2000"), (1, "1", "range", "articles", "articles:2/2147483647"), (2, "1", "range", "articles", "articles:1/4999"), (1, "1", "range", "articles", "articles:9/2")], "doc long, source_article string, kind string, target string, identifier string")
    got = {r["identifier"]: (r["status"], r["confidence"], r["targets"]) for r in res.resolve_references(refs, there).collect()}
    assert got == {"articles:1/2000": ("range_ref", 0.75, [1, 2, 900, 1500]), "articles:2/2147483647": ("range_ref", 0.75, [2, 900, 1500]), "articles:1/4999": ("not_found", 0.0, []), "articles:9/2": ("not_found", 0.0, [])}


def test_long_items_and_decisions(spark):
    title, what = "Report " + "on the state of the harbours " * 9 + "today", "the fees " + "of all harbours and " * 20 + "ports"
    p = rows(mi.parts(spark.createDataFrame([(1, f"1. {title}\nIt was agreed that {what}.\n")], "doc_id long, text string")), "kind", "a", "b")
    assert ("agenda", "1", title) in p and ("decision", "It was agreed", what) in p


def test_minutes(spark):
    d = spark.createDataFrame([(1, MINUTES), (2, None)], "doc_id long, text string")
    assert ("Chair", "Ms. A. Kahido") in rows(mi.heads(d), "field", "value")
    p = rows(mi.parts(d), "kind", "a", "b")
    assert ("agenda", "1", "Opening of the session") in p and ("speaker", "Mr. Sojaju", "Zushini") in p and ("vote", "12", "3") in p
    assert ("action", "Secretariat to report.", None) in p and any(k == "decision" and "the levy stays" in b for k, _, b in p)
    assert rows(mi.vote_counts(d)) == [(1, 12, 3, 2, "adopted")]


BILL = """A BILL
SEC. 1. SHORT TITLE.
This is it.
SEC. 2. CHANGES.
Section 6502(a) is amended by striking "old" and inserting "new".
SEC. 3. END.
Section 9 is repealed."""


def test_bills(spark):
    d = spark.createDataFrame([(1, BILL)], "doc_id long, text string")
    assert rows(mi.bill_sections(d).filter("section is not null"), "section", "title") == [("1", "SHORT TITLE"), ("2", "CHANGES"), ("3", "END")]
    c = mi.bill_changes(d)
    assert rows(c, "section", "kind", "target", "old", "new") == [("2", "strike_insert", "6502(a)", "old", "new"), ("3", "repeal", "9", None, None)]
    refs = spark.createDataFrame([("a", "9"), ("b", "9")], "source string, target string")
    assert rows(mi.affected(c, refs)) == [("6502(a)", "strike_insert", 0), ("9", "repeal", 2)]
    n = spark.createDataFrame([("b1", "a", True, "Operators shall not disclose records"), ("l1", "b", False, "Operators shall disclose records"), ("l2", "b", True, "nothing alike")], "id string, side string, negative boolean, sentence string")
    assert rows(mi.opposed_directives(n)) == [("b1", "l1", "contradiction", 4)]
    a = spark.createDataFrame([("I", "1", "a b c d e"), ("I", "2", "x")], "rule string, clause string, text string")
    b = spark.createDataFrame([("I", "1", "a b c d f"), ("I", "3", "y")], "rule string, clause string, text string")
    assert rows(mi.rule_differences(a, b)) == [("I", "1", "modified", 66, "moderate"), ("I", "2", "removed", None, None), ("I", "3", "added", None, None)]


def test_swimlanes(spark):
    e = spark.createDataFrame([("u2", datetime(2020, 1, 2), ["A", " "]), ("u1", datetime(2020, 1, 1), ["A", "B", "A"]), ("u3", None, None)], "event_uri string, ts timestamp, actors array<string>")
    assert rows(mi.swimlanes(e, "actors"), "lane", "place", "event_uri") == [("A", 1, "u1"), ("A", 2, "u2"), ("B", 1, "u1")]


VOTE = """<roll_call_vote><congress>118</congress><session>1</session><vote_number>7</vote_number><vote_date>March 3, 2023,  02:00 PM</vote_date><question>On the Motion</question><vote_result>Agreed to</vote_result>
<count><yeas>1</yeas><nays>1</nays></count><members><member><member_full>A (D-XX)</member_full><vote_cast>Yea</vote_cast></member><member><member_full>B (R-YY)</member_full><vote_cast>Not Voting</vote_cast></member></members></roll_call_vote>"""


def test_connectors(spark, tmp_path):
    (tmp_path / "v.xml").write_text(VOTE)
    v = con.read_roll_calls(spark, str(tmp_path / "v.xml"))
    t = rows(con.roll_call_triples(v))
    assert ("urn:vote:118-1-7", "reg:votesFor", "1") in t and ("urn:vote:118-1-7:a_d_xx", "reg:votePosition", "for") in t and ("urn:vote:118-1-7:b_r_yy", "reg:votePosition", "absent") in t
    assert con.votes_between(v, "2023-03-01", "2023-03-03").count() == 1 and con.votes_between(v, "2023-03-04", "2023-03-09").count() == 0
    p = spark.createDataFrame([("R1", 1, "1. Calls upon all States to act;"), ("R1", 2, "2. Decides to remain seized.")], "resolution string, number int, text string")
    assert ("urn:resolution:R1#1", "reg:obligationType", "recommendation") in rows(con.resolution_triples(p)) and ("urn:resolution:R1#2", "reg:actionVerb", "decides") in rows(con.resolution_triples(p))
    links = spark.createDataFrame([("https://a.example/1", 200, None), ("https://www.a.example/2", 404, None), ("https://b.example", None, "timeout after 30 s")], "url string, code int, error string")
    assert rows(con.link_report(links)) == [("a.example", 2, 1, 0.5), ("b.example", 1, 0, 0.0)]
    cache = spark.createDataFrame([("u", datetime(2020, 1, 1, 0)), ("v", datetime(2020, 1, 1, 2))], "url string, checked_at timestamp_ntz")
    assert rows(con.still_fresh(cache, F.lit(datetime(2020, 1, 1, 2, 30)).cast("timestamp_ntz")), "url") == [("v",)]
    m = spark.createDataFrame([("x", "ok", 10), ("x", "failed", 0), ("y", "ok", 5)], "source string, status string, size long")
    assert (None, None, 3, 15) in rows(con.download_report(m)) and ("x", None, 2, 10) in rows(con.download_report(m))
    e = spark.createDataFrame([("a", "rdf:type", "reg:Article"), ("a", "reg:title", "T"), ("a", "x:y", "z")], "s string, p string, o string")
    assert set(rows(con.with_eli(e))) - set(rows(e)) == {("a", "rdf:type", "eli:LegalResourceSubdivision"), ("a", "eli:title", "T")}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.nt").write_text('<r:A1> <rdf:type> <reg:Article> .\n<r:A1> <reg:title> "Scope" .\n<r:A1> <reg:references> <r:A2> .\n')
    g = str(tmp_path / "g.nt")
    assert main(["query", g, "articles", "--form", "csv"]) == 0 and '"r:A1","Scope"' in capsys.readouterr().out
    assert main(["query", g, "search", "--set", "word=Sco", "--form", "json"]) == 0 and '"title":"Scope"' in capsys.readouterr().out
    assert main(["impact", g, "r:A1", "--form", "csv"]) == 0 and "r:A2" in capsys.readouterr().out
    assert main(["export", g, "--form", "turtle"]) == 0 and "reg:Article" in capsys.readouterr().out
    assert main(["templates"]) == 0
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "law.txt").write_text("LAW\nArticle 1\nScope\nThe operator shall act.\n")
    assert main(["ingest", str(tmp_path / "d"), str(tmp_path / "lib")]) == 0
    assert main(["query", str(tmp_path / "lib" / "triples"), "articles", "--form", "csv"]) == 0 and "law:Art1" in capsys.readouterr().out


def test_deliberation(spark):
    from normgraph.operators import deliberation as de

    t = "series string, meeting string, place int, topic string, outcome string"
    items = spark.createDataFrame([("s", "m1", 1, "a", "deferred"), ("s", "m1", 1, "b", "pending"), ("s", "m2", 2, "a", "deferred"), ("s", "m3", 3, "a", "decided"), ("s", "m4", 4, "c", None), ("s", "m5", 5, "c", "pending")], t)
    assert rows(de.deferrals(items)) == [("s", "a", 2, 1, 2)]
    assert rows(de.inactive(items, 3)) == [("s", "b", 1, 4)]
    assert rows(de.meeting_differences(items), "place", "topic", "change") == [(2, "b", "removed"), (3, "a", "modified"), (4, "a", "removed"), (4, "c", "added"), (5, "c", "modified")]
    e = spark.createDataFrame([("x", datetime(2020, 1, 1), "proposal"), ("x", datetime(2020, 1, 1), "proposal"), ("x", datetime(2020, 1, 3), "comment"), ("x", datetime(2020, 1, 9), "adoption"), (None, None, "vote")], "subject string, at timestamp_ntz, kind string")
    c = de.event_chains(e, {"proposal": "proposed", "adoption": "adopted"})
    assert rows(c, "step", "kind", "state") == [(1, "proposal", "proposed"), (2, "comment", "proposed"), (3, "adoption", "adopted")]
    assert rows(de.chain_statistics(c)) == [("x", 3, "proposal", "adoption", "adopted", 8)]
    m = spark.createDataFrame([(" U1", False, datetime(2020, 1, 1), "s", datetime(2020, 1, 1), [("T", "x")]), ("u1", False, datetime(2020, 1, 2), "s", datetime(2020, 1, 1), [("T", "y")]), ("u2", True, datetime(2020, 1, 2), "s", datetime(2020, 1, 1), None), (None, None, None, None, None, None)], "uri string, is_deleted boolean, recorded_at timestamp_ntz, series string, meeting_date timestamp_ntz, agenda_items array<struct<title string, outcome string>>")
    assert rows(de.agenda(m)) == [("s", "u1", 1, "t", "y")]

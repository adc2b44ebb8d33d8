"""References and citations read by the grammar."""

import pytest

from normgraph.operators import extraction as ex
from normgraph.operators import grammar as g
from normgraph.operators import resolution as res
from tests.conftest import rows

FORMS = [
    ("Article 6", ["article:6"]), ("Art. 6(1)(a)", ["article:6/1/a"]), ("Articles 13 to 18", ["articles:13/18"]), ("Articles 15 and 22", ["articles:15/22"]), ("Article 6 and Article 7", ["article:6", "article:7"]),
    ("paragraph 2", ["paragraph:2"]), ("para. 2", ["paragraph:2"]), ("point (f)", ["point:f"]), ("points (a) to (f)", ["points:a/f"]), ("Chapter III", ["chapter:III"]), ("chapter 7", ["chapter:7"]), ("Section 1", ["section:1"]),
    ("Section 1798.100", ["section:1798.100"]), ("Section 1798.185(a)(1)", ["section:1798.185/a/1"]), ("subdivision (a) of Section 1798.100", ["subdivision:a/1798.100"]), ("paragraph (1) of subdivision (a) of Section 1798.185", ["paragraph:1/a/1798.185"]),
    ("Sections 1798.100 to 1798.199", ["sections:1798.100/1798.199"]), ("Sections 1798.100 through 1798.199", ["sections:1798.100/1798.199"]), ("section 1396a of this title", ["section:1396a"]), ("section 300aa-25(a)(10) of this title", ["section:300aa-25/a/10"]),
    ("section 552a of title 5", ["section:552a/5"]), ("subsection (b)(1)", ["subsection:b/1"]), ("paragraph (2) of subsection (a)", ["paragraph:2/a"]), ("subchapter II of chapter 7", ["subchapter:II/7"]), ("clause 5(a)(1) of rule XX", ["clause:5/a/1/XX"]), ("rule XX", ["rule:XX"]), ("clause 5", ["clause:5"]),
    ("section 306 of the Public Health Service Act", ["section:306/Public Health Service Act"]), ("Section 17014 of Title 18", ["section:17014/18"]), ("Directive 95/46/EC", ["directive:95/46"]), ("Directive (EU) 2016/680", ["directive:2016/680"]), ("Regulation (EU) 2016/679", ["regulation:2016/679"]), ("Regulation (EC) No 45/2001", ["regulation:45/2001"]),
    ("Decision 2010/87/EU", ["decision:2010/87"]), ("the TFEU", ["treaty:TFEU"]), ("Article 16 TFEU", ["treaty:16/TFEU"]), ("15 U.S.C. Section 1681", ["usc:15/1681"]), ("42 USC 1320d et seq.", ["usc:42/1320d/et seq."]), ("45 C.F.R. Part 164", ["cfr:45/164"]), ("Public Law 104-191", ["public_law:104/191"]),
    ("Jefferson's Manual, section 53", ["jefferson:, section 53"]), ("section 53 of Jefferson's Manual", ["section:53"]), ("8 Cannon § 3449", ["cannon:8/3449"]), ("Deschler's Precedents, ch. 21, § 18", ["deschler:, ch. 21, § 18"]), ("Deschler-Brown Precedents", ["deschler_brown"]), ("5 Hinds' Precedents", ["hinds:5"]), ("Precedents of the House", ["house_precedents"]),
    ("Human Rights Act 1998", ["act:Human Rights Act/1998"]), ("the article is long", []), ("Particle 6", []), ("rule of law", []), ("", []),
]


@pytest.mark.parametrize(("text", "want"), FORMS)
def test_forms(text, want):
    for before, after in (("", ""), ("See ", "."), ("(under ", ", which holds)")):
        found = list(g.references_in(before + text + after))
        assert [r.identifier for r in found] == want
        assert all((before + text + after)[r.start : r.end] in text for r in found)


def test_levels_and_kinds():
    (r,) = g.references_in("under paragraph (1) of subdivision (a) of Section 1798.185")
    assert r.kind == "internal" and r.levels == {"paragraph": "1", "subdivision": "a", "section": "1798.185"}
    assert [x.kind for x in g.references_in("section 552a of title 5; section 5 of this title; section 306 of the Public Health Service Act")] == ["external", "internal", "external"]
    assert [x.within for x in g.references_in("Article 5 of Regulation (EU) 2016/679")] == ["regulation"]


def test_citation_forms():
    of = lambda t: [(f.kind, f.jurisdiction) for f, _ in g.citations_in(t) if f.kind != "named_act"]
    assert of("[2019] UKSC 41") == [("case", "uk")] and of("[1990] 2 AC 605") == [("case", "uk")] and of("410 U.S. 113") == [("case", "us")] and of("Case C-131/12") == [("case", "eu")]
    assert of("SI 2019/419") == [("si", "uk")] and ("act_chapter", "uk") in of("Human Rights Act 1998 c. 42") and of("110 Stat. 1936") == [("statutes", "us")]


def test_resolution_of_all_units(spark):
    p = [("d", "I", "1", "1", "1", "a"), ("d", "I", "1", "1", "2", "b"), ("d", "I", "2", "2", None, None), ("d", "II", "1", "3", "1", None), ("d", "II", "4", "4", None, None), ("d", "III", "4", "5", "1", "c")]
    there = spark.createDataFrame(p, "doc string, chapter string, section string, article string, paragraph string, point string")
    text = "paragraph 2; paragraph 9; point (a); point (b); point (x); points (a) to (b); points (a) to (c); Chapter II; Chapter IX; Section 1; Section 2; Section 4; Section 9; paragraph 1 of Article 3; rule III; annex I"
    refs = ex.references(spark.createDataFrame([("d", text)], "doc string, text string"), "doc").withColumn("source_article", F_lit("1")).withColumn("source_chapter", F_lit("I"))
    got = {r["identifier"]: (r["status"], r["confidence"]) for r in res.resolve_references(refs, there).collect()}
    assert got == {
        "paragraph:2": ("resolved", 1.0), "paragraph:9": ("partial", 0.75), "point:a": ("resolved", 1.0), "point:b": ("resolved", 0.75), "point:x": ("partial", 0.5), "points:a/b": ("range_ref", 1.0), "points:a/c": ("range_ref", 0.75),
        "chapter:II": ("resolved", 1.0), "chapter:IX": ("not_found", 0.0), "section:1": ("resolved", 1.0), "section:2": ("resolved", 1.0), "section:4": ("ambiguous", 0.5), "section:9": ("not_found", 0.0),
        "paragraph:1/3": ("resolved", 1.0), "rule:III": ("resolved", 1.0), "annex:I": ("not_found", 0.0),
    }
    report = res.resolution_report(res.resolve_references(refs, there)).first()
    assert (report["n"], report["n_ambiguous"], report["n_low"]) == (16, 1, 2)


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_terms_of_any_length(spark):
    d = spark.createDataFrame([(1, "The right to be informed of the use of data. Rights to be informed of the use of datas, use."), (2, None)], "doc_id long, text string")
    t = spark.createDataFrame([("right to be informed of the use of data",), ("use",), ("",), (None,)], "term string")
    assert rows(ex.term_usage(d, t), "term", "n") == [("right to be informed of the use of data", 1), ("use", 3)]

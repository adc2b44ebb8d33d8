"""Legal citations in texts: parsing for several jurisdictions, one per place, and their identifiers and addresses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normgraph.operators.grammar import citations_in

def _citations(jurisdiction: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                mine = list(citations_in(text, jurisdiction)) if text else []
                rows += [row] * len(mine)
                found += mine
            out = {
                "rule": pa.array([f"{f.jurisdiction}:{f.kind}" for f, _ in found], pa.string()), "confidence": pa.array([f.confidence for f, _ in found], pa.float64()),
                "start": pa.array([m.start() for _, m in found], pa.int64()), "end": pa.array([m.end() for _, m in found], pa.int64()), "matched": pa.array([m.group() for _, m in found], pa.string()),
                "groups": pa.array([[g.strip() for g in m.groups() if g and g.strip()] for _, m in found], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(rows, pa.int64())), *out.values()], names=["key", *out])

    return run


def citations(documents: DataFrame, jurisdiction: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, jurisdiction, type, parts, start, end, matched, confidence), without overlaps.

    Where citations overlap, one counts only if none of higher confidence (then of an earlier start, then of the
    longer text) overlaps it.
    """
    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    hits = rows.mapInArrow(_citations(jurisdiction), f"key {kind}, rule string, confidence double, start long, end long, matched string, groups array<string>").withColumnRenamed("key", key)
    hits = hits.withColumn("rank", F.struct(-F.col("confidence"), "start", -F.col("end"), "rule"))
    # a chain of overlapping spans is one island; in it, the best spans that no better one overlaps
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") < reach, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    members = F.sort_array(F.collect_list(F.struct("rank", "start", "end", "rule", "groups", "matched", "confidence")))
    g = hits.withColumn("island", island).groupBy(key, "island").agg(members.alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), acc).otherwise(F.concat(acc, F.array(x))))
    out = g.select(key, F.explode(kept).alias("c"))
    part = lambda k: F.split_part("c.rule", F.lit(":"), F.lit(k))
    return out.select(key, part(1).alias("jurisdiction"), part(2).alias("type"), F.col("c.groups").alias("parts"), "c.start", "c.end", "c.matched", "c.confidence")


def _year(c: Column) -> Column:
    return F.when(F.length(c) == 2, F.concat(F.lit("19"), c)).otherwise(c)


def celex(kind: Column, year: Column, number: Column) -> Column:
    """CELEX number of EU legislation: sector 3, year, letter of the type, number in four digits."""
    letter = F.when(kind == "regulation", "R").when(kind == "directive", "L").when(kind == "decision", "D")
    return F.concat(F.lit("3"), _year(year), letter, F.lpad(number, 4, "0"))


def eli(kind: Column, year: Column, number: Column) -> Column:
    short = F.when(kind == "regulation", "reg").when(kind == "directive", "dir").when(kind == "decision", "dec")
    return F.concat(F.lit("http://data.europa.eu/eli/"), short, F.lit("/"), _year(year), F.lit("/"), number, F.lit("/oj"))


def urn(jurisdiction: Column, kind: Column, a: Column, b: Column) -> Column:
    """URN of a citation with parts a and b."""
    eu = jurisdiction == "eu"
    return (
        F.when(eu & kind.isin("regulation", "directive", "decision"), F.concat(F.lit("urn:eu:"), kind, F.lit(":"), a, F.lit("/"), b))
        .when(eu & (kind == "treaty"), F.concat(F.lit("urn:eu:treaty:"), F.lower(b), F.lit("/"), a))
        .when(kind == "usc", F.concat(F.lit("urn:us:usc:"), a, F.lit("/"), b)).when(kind == "cfr", F.concat(F.lit("urn:us:cfr:"), a, F.lit("/"), b)).when(kind == "public_law", F.concat(F.lit("urn:us:pl:"), a, F.lit("-"), b))
        .when(kind == "si", F.concat(F.lit("urn:uk:si:"), a, F.lit("/"), b)).when(kind == "act", F.concat(F.lit("urn:uk:act:"), F.regexp_replace(F.lower(a), r"\s+", "-"), F.lit("/"), b))
    )


def address(u: Column) -> Column:
    """Public web address of a URN, null where none is known."""
    part = lambda k: F.regexp_extract(u, r"^urn:\w+:\w+:([^/-]+)[/-](.+)$", k)
    return (
        F.when(u.startswith("urn:us:usc:"), F.concat(F.lit("https://uscode.house.gov/view.xhtml?req=granuleid:USC-prelim-title"), part(1), F.lit("-section"), part(2)))
        .when(u.startswith("urn:us:cfr:"), F.concat(F.lit("https://www.ecfr.gov/current/title-"), part(1), F.lit("/part-"), F.regexp_extract(part(2), r"^(\d+)", 1)))
        .when(u.startswith("urn:us:pl:"), F.concat(F.lit("https://www.congress.gov/public-laws/"), part(1), F.lit("/"), part(2)))
        .when(u.startswith("urn:uk:si:"), F.concat(F.lit("https://www.legislation.gov.uk/uksi/"), part(1), F.lit("/"), part(2)))
        .when(u.rlike("^urn:eu:(regulation|directive|decision):"), F.concat(F.lit("https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"), celex(F.regexp_extract(u, r"^urn:eu:(\w+)", 1), part(1), part(2))))
    )


def with_identifiers(cited: DataFrame) -> DataFrame:
    """Citations with urn and address."""
    u = urn(F.col("jurisdiction"), F.col("type"), F.get("parts", F.lit(0)), F.get("parts", F.lit(1)))
    return cited.withColumn("urn", u).withColumn("address", address(F.col("urn")))

"""Downloaded statutes and resolutions as plain text and rows: XML of codes, Akoma Ntoso, and bulk ingestion into a library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.functions.text import html_text
from normgraph.sources.library import Library

# Elements of code XML that begin a line, and those whose text stands on the line of their number.
_LINES = "title|subtitle|chapter|subchapter|part|subpart|section|subsection|paragraph|subparagraph|clause|level|content|chapeau|continuation|p|P|HEAD|DIV[1-9]|FP|CITA|note"
_HEADS = "num|heading|enum|header"


def _entities(c: Column) -> Column:
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#167;", "§"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(to))
    return c


def code_text(xml: Column) -> Column:
    """Text of the XML of a code (USLM or CFR): a line for each unit, numbers and headings on one; metadata and notes of sources dropped."""
    c = F.regexp_replace(xml, r"(?s)<\?.*?\?>|<!--.*?-->|<(meta|SOURCE|AUTH|TOC|toc)\b.*?</\1\s*>", "")
    c = F.regexp_replace(c, rf"</(?:{_HEADS})>\s*<(?:{_HEADS})\b[^>]*>", " ")
    c = F.regexp_replace(c, rf"\s*</?(?:{_LINES})\b[^>]*>\s*", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"[ \t\r\f]+", " ")
    return _entities(F.trim(F.regexp_replace(F.regexp_replace(c, r" ?\n[ \n]*", "\n"), r"^\n+|\n+$", "")))


def akoma_ntoso(spark: SparkSession, path: str) -> DataFrame:
    """(resolution, number, text) of the numbered paragraphs of Akoma Ntoso files, for ``connectors.resolution_triples``.

    The resolution is the document's FRBR alias or, without one, the file's name. Namespaces do not matter. Files without paragraphs give no rows.
    """
    named = lambda n: f"*[local-name()='{n}']"
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^\s*<\?[^>]*\?>", "").alias("x"))
    alias = F.xpath_string("x", F.lit(f"//{named('FRBRalias')}/@value"))
    numbers = F.xpath("x", F.lit(f"//{named('paragraph')}/{named('num')}/text()"))
    # a paragraph's text may hold other elements: it is taken whole, without its number
    bodies = F.regexp_extract_all("x", F.lit(r"(?s)<(?:\w+:)?paragraph\b[^>]*>.*?</(?:\w+:)?num>(.*?)</(?:\w+:)?paragraph>"), F.lit(1))
    rows = t.select(F.coalesce(F.nullif(alias, F.lit("")), F.regexp_extract("path", r"([^/]+?)(?:\.\w+)?$", 1)).alias("resolution"), F.explode(F.arrays_zip(numbers.alias("n"), bodies.alias("b"))).alias("p"))
    text = _entities(F.trim(F.regexp_replace(F.regexp_replace("p.b", r"<[^>]*>", " "), r"\s+", " ")))
    return rows.select("resolution", F.regexp_extract("p.n", r"(\d+)", 1).try_cast("int").alias("number"), text.alias("text")).filter("number is not null")


def readable(content: Column, name: Column) -> Column:
    """Text of a download by its name: code XML, HTML, or as it is."""
    lower = F.lower(name)
    return F.when(lower.endswith(".xml"), code_text(content)).when(lower.rlike(r"\.x?html?$"), html_text(content)).otherwise(content)


def ingest_downloads(library: Library, downloads: DataFrame, to_triples: Callable[[DataFrame], DataFrame], title_contains: str | None = None, force: bool = False) -> DataFrame:
    """Put downloads (source, doc, title, name, content) into a library; (source, status, n): what became of them.

    With ``title_contains``, only titles that hold it (case ignored) are read, the others are 'filtered'; without text a
    download is 'empty'; ones that are in the library already are 'present' unless ``force``; the rest are 'ingested'.
    """
    d = downloads.withColumn("text", readable(F.col("content"), F.col("name")))
    wanted = F.lit(True) if title_contains is None else F.coalesce(F.contains(F.lower("title"), F.lit(title_contains.lower())), F.lit(False))
    known = library.documents().filter("status = 'ready'").select("doc", F.lit(True).alias("there")) if library._has("manifest") and not force else None
    d = d.join(known, "doc", "left") if known is not None else d.withColumn("there", F.lit(None).cast("boolean"))
    status = F.when(~wanted, "filtered").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.col("there"), "present").otherwise("ingested")
    d = d.withColumn("status", status)
    report = d.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))
    done = library.spark.createDataFrame(report.collect(), report.schema)  # a row per source and status, before the library changes
    library.ingest(d.filter("status = 'ingested'").select("doc", "text"), to_triples, force)
    return done

"""Records of outside sources, once downloaded, as triples: roll-call votes and resolutions; and reports on downloads and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.functions.text import domain, slug

_VOTE = "congress int, session int, vote_number int, vote_date string, question string, vote_result string, count struct<yeas: int, nays: int, present: int, absent: int>, members struct<member: array<struct<member_full: string, party: string, state: string, vote_cast: string>>>"


def _triples(rows: DataFrame, subject: Column, pairs: dict[str, Column]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o")) for p, o in pairs.items()])).alias("t")
    return rows.select(subject.alias("s"), each).select("s", "t.p", "t.o").filter("o is not null and o <> ''")


def read_roll_calls(spark: SparkSession, path: str) -> DataFrame:
    """Roll-call votes of XML files, one row per vote."""
    return spark.read.format("xml").option("rowTag", "roll_call_vote").schema(_VOTE).load(path)


def position(cast: Column) -> Column:
    c = F.lower(F.trim(cast))
    return F.when(c.isin("yea", "aye", "yes", "guilty"), "for").when(c.isin("nay", "no", "not guilty"), "against").when(c.startswith("present"), "abstain").otherwise("absent")


def roll_call_triples(votes: DataFrame, base: str = "urn:vote:") -> DataFrame:
    """(s, p, o) of votes and of each member's vote in them."""
    v = votes.withColumn("uri", F.concat_ws("-", F.concat(F.lit(base), "congress"), "session", "vote_number"))
    head = _triples(v, F.col("uri"), {"rdf:type": F.lit("reg:VoteRecord"), "reg:voteDate": F.col("vote_date"), "reg:voteQuestion": F.col("question"), "reg:voteResult": F.col("vote_result"), "reg:votesFor": F.col("count.yeas"), "reg:votesAgainst": F.col("count.nays"), "reg:votesAbsent": F.col("count.absent")})
    m = v.select("uri", F.explode("members.member").alias("m")).withColumn("mine", F.concat("uri", F.lit(":"), slug(F.col("m.member_full"))))
    each = _triples(m, F.col("mine"), {"rdf:type": F.lit("reg:IndividualVote"), "reg:partOf": F.col("uri"), "reg:voter": F.col("m.member_full"), "reg:votePosition": position(F.col("m.vote_cast")), "reg:party": F.col("m.party"), "reg:state": F.col("m.state")})
    return head.unionByName(each)


def votes_between(votes: DataFrame, start: str, end: str, form: str = "MMMM d, yyyy") -> DataFrame:
    """Votes of a range of days, both included."""
    day = F.try_to_date(F.regexp_extract("vote_date", r"^(\w+ \d+, \d{4})", 1), form)
    return votes.filter((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")))


# Operative verbs of resolutions and the kind of duty they make.
VERBS = {"decides": "binding", "requests": "request", "urges": "recommendation", "recommends": "recommendation", "calls upon": "recommendation", "encourages": "recommendation", "invites": "invitation", "condemns": "statement", "reaffirms": "statement", "welcomes": "statement", "notes": "statement", "demands": "binding"}


def resolution_triples(paragraphs: DataFrame, base: str = "urn:resolution:") -> DataFrame:
    """(s, p, o) of operative paragraphs (resolution, number, text) with their verb and kind."""
    verb = F.coalesce(*[F.when(F.lower(F.trim("text")).rlike(rf"^(?:\d+\.\s*)?(?:also |further |strongly )?{v}\b"), v) for v in VERBS])
    kinds = F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])
    r = paragraphs.withColumn("verb", verb)
    s = F.concat(F.lit(base), "resolution", F.lit("#"), F.col("number").cast("string"))
    return _triples(r, s, {"rdf:type": F.lit("reg:OperativeClause"), "reg:partOf": F.concat(F.lit(base), "resolution"), "reg:number": F.col("number"), "reg:text": F.col("text"), "reg:actionVerb": F.col("verb"), "reg:obligationType": kinds[F.col("verb")]})


def download_report(manifest: DataFrame) -> DataFrame:
    """(source, status, n, bytes) of downloads (source, status, size), with totals, whose keys are null."""
    return manifest.rollup("source", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def link_status(code: Column, error: Column) -> Column:
    """Class of a link check: valid, redirect, invalid, timeout or error."""
    return F.when(error.isNotNull() & F.lower(error).contains("timeout"), "timeout").when(error.isNotNull() | code.isNull(), "error").when(code.between(200, 299), "valid").when(code.between(300, 399), "redirect").otherwise("invalid")


def link_report(checks: DataFrame) -> DataFrame:
    """(domain, n, n_ok, rate) of link checks (url, code, error); redirects count as good."""
    c = checks.withColumn("status", link_status(F.col("code"), F.col("error"))).withColumn("domain", domain(F.col("url")))
    ok = F.count_if(F.col("status").isin("valid", "redirect"))
    return c.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), ok.alias("n_ok"), (ok / F.count(F.lit(1))).alias("rate"))


def still_fresh(cache: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """Entries of a cache (.., checked_at) younger than a time to live."""
    return cache.filter(F.timestamp_diff("SECOND", F.col("checked_at"), now) < seconds)


# Classes and properties of the European legislation identifier for those of the graph.
ELI_CLASSES = {
    "reg:Regulation": "eli:LegalResource", "reg:Directive": "eli:LegalResource", "reg:Decision": "eli:LegalResource",
    "reg:Chapter": "eli:LegalResourceSubdivision", "reg:Section": "eli:LegalResourceSubdivision", "reg:Article": "eli:LegalResourceSubdivision", "reg:Paragraph": "eli:LegalResourceSubdivision",
    "reg:Point": "eli:LegalResourceSubdivision", "reg:Preamble": "eli:LegalResourceSubdivision", "reg:Recital": "eli:LegalResourceSubdivision",
}
ELI_PROPERTIES = {
    "reg:title": "eli:title", "reg:number": "eli:id_local", "reg:identifier": "eli:id_local", "reg:partOf": "eli:is_part_of", "reg:contains": "eli:has_part",
    "reg:date": "eli:date_document", "reg:version": "eli:version", "reg:references": "eli:cites", "reg:referencedBy": "eli:cited_by",
}
#: Types of documents that the identifier is made for; others stay as they are.
ELI_DOCUMENTS = ("regulation", "directive", "decision")


def with_eli(triples: DataFrame, document_type: str | Column = "regulation") -> DataFrame:
    """Triples and their counterparts under the European legislation identifier.

    ``document_type`` is that of all triples or a column of theirs; only those of the European types get counterparts.
    """
    lookup = lambda d, c: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[c]
    kind = F.lit(document_type) if isinstance(document_type, str) else document_type
    t = triples.select("s", "p", "o", F.coalesce(F.lower(kind).isin(*ELI_DOCUMENTS), F.lit(False)).alias("eu"))
    typed = t.filter("eu and p = 'rdf:type'").select("s", "p", lookup(ELI_CLASSES, F.col("o")).alias("o"))
    linked = t.filter("eu").select("s", lookup(ELI_PROPERTIES, F.col("p")).alias("p"), "o")
    return t.drop("eu").unionByName(typed.dropna()).unionByName(linked.dropna()).distinct()

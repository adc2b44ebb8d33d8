"""References to provisions resolved by joins, mentions matched to known names, keywords to provisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normgraph.functions.text import bag_similarity
from normgraph.staging import Staged


def split_paragraphs(provisions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph, point, body): numbered paragraphs and lettered points of each provision's text.

    A line '1. ...' opens a paragraph and '(a) ...' a point, unless what follows reads on as a reference
    ('(a) of paragraph 2'). Text before any paragraph has null in both.
    """
    line = F.posexplode(F.split(F.coalesce(provisions[text], F.lit("")), r"\r\n|\r|\n"))
    rows = provisions.select(provisions[key].alias(key), line.alias("n", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    para = F.when(F.col("line").rlike(r"^\d{1,3}\.\s+\S"), F.struct("n", F.regexp_extract("line", r"^(\d+)", 1).alias("v")))
    point = F.when(F.col("line").rlike(r"^\([a-z]\)\s+(?!of\b|and\b|or\b|to\b)\S"), F.struct("n", F.regexp_extract("line", r"^\(([a-z])\)", 1).alias("v")))
    rows = rows.withColumn("pa", F.last(para, ignorenulls=True).over(w)).withColumn("po", F.last(point, ignorenulls=True).over(w))
    rows = rows.withColumn("po", F.when(F.col("pa").isNull() | (F.col("po.n") > F.col("pa.n")), F.col("po")))
    out = rows.groupBy(key, F.col("pa.v").alias("paragraph"), F.col("po.v").alias("point")).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("ls"))
    return out.select(key, "paragraph", "point", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("body"))


def _index(provisions: DataFrame) -> DataFrame:
    """(doc, unit, k, n): what there is to refer to: chapters, sections, articles, paragraphs and points by a key of the
    numbers above them; n is in how many chapters a section of that number is."""
    p = provisions.withColumns({c: F.col(c).cast("string") if c in provisions.columns else F.lit(None).cast("string") for c in ("chapter", "section", "article", "paragraph", "point")})
    one = lambda unit, *parts: F.when(F.greatest(*[x.isNull() for x in parts]) if len(parts) > 1 else parts[0].isNull(), None).otherwise(F.struct(F.lit(unit).alias("unit"), F.concat_ws("/", *parts).alias("k"), F.lit("").alias("of")))
    c = {x: F.col(x) for x in ("chapter", "section", "article", "paragraph", "point")}
    units = [
        one("chapter", c["chapter"]), one("section", c["chapter"], c["section"]), one("article", c["article"]), one("paragraph", c["article"], c["paragraph"]), one("point", c["article"], c["paragraph"], c["point"]), one("any point", c["article"], c["point"]),
        F.when(c["section"].isNotNull(), F.struct(F.lit("any section").alias("unit"), c["section"].alias("k"), F.coalesce(c["chapter"], F.lit("")).alias("of"))),
    ]
    rows = p.select("doc", F.explode(F.array_compact(F.array(*units))).alias("u")).select("doc", "u.*").distinct()
    return rows.groupBy("doc", "unit", "k").agg(F.count(F.lit(1)).alias("n"))


def resolve_references(refs: DataFrame, provisions: DataFrame) -> DataFrame:
    """References with status, confidence and the targets found.

    refs: (doc, source_article, kind, target, identifier) as :func:`~normgraph.operators.extraction.references`
    gives them, with the document and article they stand in, and with ``levels`` and perhaps source_chapter; without
    levels only articles are resolved. provisions: (doc, article) and perhaps chapter, section, paragraph and point, nulls
    for what a provision has not. Article numbers are compared as numbers. A paragraph or point without an article is
    looked for in the article the reference stands in, a point without a paragraph first in paragraph 1.

    Status: 'external' for other instruments; 'self_ref' for an article's reference to itself; 'resolved' if
    article and, if named, paragraph and point exist (confidence 1), or if a point is in another paragraph or a section
    in one other chapter (0.75); 'partial' if only the article does (0.75, for points 0.5);
    'range_ref' for a range of articles or points all or in part there (1 or 0.75);
    'ambiguous' for a section of several other chapters (0.5); else 'not_found' (0). targets: article numbers.
    """
    parts = F.split(F.split_part("identifier", F.lit(":"), F.lit(2)), "/")
    at = lambda k: F.get(parts, F.lit(k))
    first, second = at(0).try_cast("int"), at(1).try_cast("int")
    leveled = "levels" in refs.columns
    r = refs.withColumn("rid", F.monotonically_increasing_id())
    for c in ("source_chapter",) if leveled else ():
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast("string"))
    r = Staged(r, "refs").df  # the numbers of rows must not change between the joins
    ranged = F.col("target") == "articles"
    last = F.when(ranged & (second >= first), second).when((F.col("target") == "article") & first.isNotNull(), first)
    r = r.withColumn("last_", last).withColumn("first_", F.when(F.col("last_").isNotNull(), first)).withColumn("paragraph_", F.when(F.col("target") == "article", at(1))).withColumn("point_", F.when(F.col("target") == "article", at(2)))
    known = provisions.select("doc", F.col("article").try_cast("int").alias("article"), *[F.col(c) if c in provisions.columns else F.lit(None).cast("string").alias(c) for c in ("paragraph", "point")]).filter("article is not null").distinct()
    each = r.filter("last_ is not null").select("rid", "doc", "paragraph_", "point_", "first_", "last_")
    single = each.filter("first_ = last_").join(known.withColumnRenamed("article", "first_"), ["doc", "first_"]).withColumn("article", F.col("first_"))
    wide = each.filter("first_ < last_").join(known.select("doc", "article").distinct(), "doc").filter(F.col("article").between(F.col("first_"), F.col("last_")))
    j = single.unionByName(wide, allowMissingColumns=True)
    inner = (F.col("paragraph_").isNull() | F.col("paragraph").eqNullSafe(F.col("paragraph_"))) & (F.col("point_").isNull() | F.col("point").eqNullSafe(F.col("point_")))
    found = j.groupBy("rid").agg(F.countDistinct("article").alias("articles"), F.max(inner).alias("inner"), F.sort_array(F.collect_set("article")).alias("targets"))
    out = r.join(found, "rid", "left")
    n, size = F.coalesce("articles", F.lit(0)), F.coalesce(F.col("last_").cast("long") - F.col("first_") + 1, F.lit(0))
    to_article = size > 0
    status = (
        F.when(F.col("kind") == "external", "external").when(to_article & (n == 0), "not_found").when(to_article & ranged, "range_ref")
        .when(to_article & (F.col("first_") == F.col("source_article").try_cast("int")) & F.col("paragraph_").isNull(), "self_ref").when(to_article & F.col("inner"), "resolved").when(to_article, "partial")
    )
    confidence = F.when(status.isin("external", "self_ref", "resolved") | ((status == "range_ref") & (n == size)), 1.0).when(status.isin("partial", "range_ref"), 0.75).when(status == "not_found", 0.0)
    targets = F.coalesce("targets", F.array().cast("array<int>"))
    if leveled:
        hits = _probe(r.filter("kind <> 'external' and target not in ('article', 'articles')"), provisions)
        out = out.join(hits, "rid", "left")
        more, sure = _other_units()
        status, confidence = F.coalesce(status, more), F.coalesce(confidence, sure)
        own = F.when(F.map_contains_key("hit", F.lit("article")), F.array(F.coalesce(F.col("levels")["article"], F.col("source_article")).try_cast("int")))
        targets = F.when(to_article, targets).otherwise(F.coalesce(own, targets))
    return out.select("doc", "source_article", "kind", "target", "identifier", F.coalesce(status, F.lit("not_found")).alias("status"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), targets.alias("targets"))


def _probe(r: DataFrame, provisions: DataFrame) -> DataFrame:
    """(rid, hit, n_points) of references to other units than articles: the units found of those that decide, with their numbers."""
    level = lambda c: F.col("levels")[c]
    article = F.coalesce(level("article"), F.col("source_article"))
    key = lambda unit, *p: F.struct(F.lit(unit).alias("unit"), F.when(~F.greatest(*[x.isNull() for x in p], F.lit(False)), F.concat_ws("/", *p)).alias("k"))
    letters = F.split(F.split_part("identifier", F.lit(":"), F.lit(2)), "/")
    a, z = F.ascii(F.get(letters, F.lit(0))), F.ascii(F.get(letters, F.lit(1)))
    spread = F.when((F.col("target") == "points") & (z > a) & (z - a < 26), F.transform(F.sequence(a, z), lambda x: key("any point", article, F.char(x)))).otherwise(F.array())
    probes = F.concat(F.array(key("article", article), key("paragraph", article, level("paragraph")), key("point", article, F.coalesce(level("paragraph"), F.lit("1")), level("point")), key("any point", article, level("point")), key("chapter", F.coalesce(level("chapter"), level("rule"))), key("section", F.col("source_chapter"), level("section")), key("any section", level("section")), F.struct(F.lit("section as article").alias("unit"), level("section").alias("k"))), spread)
    asked = r.select("rid", "doc", F.explode(F.array_distinct(probes)).alias("p")).select("rid", "doc", "p.*").filter("k is not null")
    index = _index(provisions)
    index = index.unionByName(index.filter("unit = 'article'").withColumn("unit", F.lit("section as article")))
    found = asked.join(index, ["doc", "unit", "k"])
    return found.groupBy("rid", "unit").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m")).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("unit", "n"))).alias("hit"), F.max(F.when(F.col("unit") == "any point", F.col("m"))).alias("n_points"))


def _other_units() -> tuple[Column, Column]:
    """Status and confidence of references to paragraphs, points, chapters and sections, from what was found of them."""
    has = lambda u: F.coalesce(F.map_contains_key("hit", F.lit(u)), F.lit(False))
    t = F.col("target")
    letters = F.split(F.split_part("identifier", F.lit(":"), F.lit(2)), "/")
    asked = F.ascii(F.get(letters, F.lit(1))) - F.ascii(F.get(letters, F.lit(0))) + 1
    near = F.col("hit")["any section"]
    cases = (
        (t.isin("paragraph", "paragraphs") & has("paragraph"), "resolved", 1.0), (t.isin("paragraph", "paragraphs") & has("article"), "partial", 0.75),
        ((t == "points") & (F.col("n_points") == asked), "range_ref", 1.0), ((t == "points") & (F.col("n_points") > 0), "range_ref", 0.75),
        ((t == "point") & has("point"), "resolved", 1.0), ((t == "point") & has("any point"), "resolved", 0.75), (t.isin("point", "points") & has("article"), "partial", 0.5),
        (t.isin("chapter", "rule") & has("chapter"), "resolved", 1.0),
        (t.isin("section", "sections") & has("section"), "resolved", 1.0), (t.isin("section", "sections") & (near == 1), "resolved", 0.75), (t.isin("section", "sections") & (near > 1), "ambiguous", 0.5), (t.isin("section", "sections") & has("section as article"), "resolved", 1.0),
    )
    status, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    for test, s, c in reversed(cases):
        status, sure = F.when(test, s).otherwise(status), F.when(test, c).otherwise(sure)
    return status, sure


def resolution_report(resolved: DataFrame) -> DataFrame:
    """One row: references by status, those of high, medium, low and no confidence, and the rate resolved, in part or as a range among internal ones."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    internal = F.count_if(F.col("status") != "external")
    return resolved.agg(F.count(F.lit(1)).alias("n"), of("resolved").alias("n_resolved"), of("partial").alias("n_partial"), of("range_ref").alias("n_range"), of("self_ref").alias("n_self"), of("external").alias("n_external"), of("not_found").alias("n_not_found"), of("ambiguous").alias("n_ambiguous"), *[F.count_if(F.col("confidence") == c).alias(k) for k, c in (("n_high", 1.0), ("n_medium", 0.75), ("n_low", 0.5), ("n_none", 0.0))], F.when(internal > 0, of("resolved", "partial", "range_ref") / internal).otherwise(0.0).alias("rate"))


def match_mentions(mentions: DataFrame, aliases: DataFrame, least: float = 0.8) -> DataFrame:
    """(mention, entity, score): the best entity of each mention by the similarity of words, at least ``least``.

    mentions: (mention); aliases: (entity, alias). Only pairs that share a word are compared; they meet in a join
    on the word. Equal names score 1; ties go to the least entity. Nulls match nothing.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))
    m = mentions.select("mention").dropna().distinct()
    a = aliases.select("entity", "alias").dropna().distinct()
    pairs = m.withColumn("w", F.explode(words(F.col("mention")))).join(a.withColumn("w", F.explode(words(F.col("alias")))), "w").select("mention", "entity", "alias").distinct()
    scored = pairs.withColumn("score", bag_similarity(F.col("alias"), F.col("mention"))).filter(F.col("score") >= least)
    return scored.groupBy("mention").agg(F.max(F.struct("score")).alias("s"), F.min_by("entity", F.struct(-F.col("score"), "entity")).alias("entity")).select("mention", "entity", F.col("s.score").alias("score"))


def keyword_matches(provisions: DataFrame, keywords: DataFrame, key: str, text: Column, shortest: int = 4) -> DataFrame:
    """(key, n_keywords, score): provisions that hold keywords (word, weight), by a join on the word."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= shortest))
    index = provisions.select(provisions[key].alias(key), F.explode(words).alias("word"))
    k = keywords.select(F.lower("word").alias("word"), "weight").groupBy("word").agg(F.max("weight").alias("weight"))
    return index.join(k, "word").groupBy(key).agg(F.count(F.lit(1)).alias("n_keywords"), F.sum("weight").alias("score"))


def scenario_matches(provisions: DataFrame, references: DataFrame, direct: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, relevance, score) of provisions for a scenario.

    provisions: (id, text); references: (source, target); direct: (id, score) that match by what they grant or
    impose; keywords: (word). What direct ones refer to is 'triggered' with 0.6, what refers to them with 0.7, what
    holds a keyword is 'related' with 0.3; each keyword adds 0.05, up to 1. The best relevance of a provision counts.
    """
    d = direct.groupBy("id").agg(F.max("score").alias("score"))
    inward = references.join(d.select(F.col("id").alias("target")), "target").select(F.col("source").alias("id"), F.lit(0.7).alias("score"))
    outward = references.join(d.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id"), F.lit(0.6).alias("score"))
    hits = keyword_matches(provisions, keywords.select("word", F.lit(1.0).alias("weight")), "id", F.col("text"))
    every = d.select("id", F.lit(2).alias("k"), "score").unionByName(inward.unionByName(outward).select("id", F.lit(1).alias("k"), "score")).unionByName(hits.select("id", F.lit(0).alias("k"), F.lit(0.3).alias("score")))
    best = every.groupBy("id").agg(F.max(F.struct("k", "score")).alias("b"))
    out = best.join(hits.select("id", "n_keywords"), "id", "left")
    return out.select("id", F.element_at(F.array(F.lit("related"), F.lit("triggered"), F.lit("direct")), F.col("b.k") + 1).alias("relevance"), F.least(F.lit(1.0), F.col("b.score") + 0.05 * F.coalesce("n_keywords", F.lit(0))).alias("score"))

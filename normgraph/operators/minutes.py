"""Minutes and bills as rows: heads, agendas, speakers, decisions, actions, votes, sections and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normgraph.functions.text import change_label, word_similarity
from normgraph.operators.extraction import amendments, lines, scan_patterns

# Lines of a head, agenda items, and phrases of minutes.
HEAD = ("Date", "Time", "Location", "Chair", "Secretary", "Present", "Apologies", "Absent")
MINUTES = (
    ("agenda", r"(?m)^\s*(?:Item\s+)?(\d{1,2})[.:)]\s+([A-Z][^\n]{2,})$"),
    ("speaker", r"(?m)^\s*((?:Mr|Ms|Mrs|Dr|Prof)\.\s+[A-Z][\w.' -]+?|The\s+(?:Chair|Rapporteur|Secretariat)|[A-Z][A-Z' -]{2,40})(?:\s+\(([^)]+)\))?:\s+(\S[^\n]*)"),
    ("decision", r"(?i)\b((?:it\s+was\s+)?(?:decided|agreed|resolved|adopted|approved|rejected|deferred))\b\s*(?:that|to|on|:)?\s*([^\n.]{3,})"),
    ("action", r"(?i)\baction(?:\s+item)?s?\s*:\s*([^\n]+)"),
    ("vote", r"(?i)\b(\d+)\s+(?:votes?\s+)?(?:in\s+favou?r|for)\b[^\d\n]{1,20}(\d+)\s+(?:votes?\s+)?against\b(?:[^\d\n]{1,20}(\d+)\s+abst\w*)?"),
)


def heads(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, field, value): the 'Field: value' lines of minutes, the first of each field."""
    rows = lines(documents, key, text)
    rows = rows.select(key, "line_no", F.regexp_extract("line", r"^(\w+):\s*(.+)$", 1).alias("field"), F.regexp_extract("line", r"^(\w+):\s*(.+)$", 2).alias("value"))
    return rows.filter(F.col("field").isin(list(HEAD))).groupBy(key, "field").agg(F.min_by("value", "line_no").alias("value"))


def parts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, a, b, c, start): agenda items (number, title), speakers (name, affiliation, words), decisions (verb, text), actions (text) and votes (for, against, abstaining)."""
    hits = scan_patterns(documents, MINUTES, key, text, overlap=True)
    at = lambda k: F.get("groups", F.lit(k))
    return hits.select(key, F.col("rule").alias("kind"), at(0).alias("a"), at(1).alias("b"), at(2).alias("c"), "start")


def vote_counts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_for, n_against, n_abstain, outcome) of each recorded count; a tie has no outcome."""
    v = parts(documents, key, text).filter("kind = 'vote'")
    f, a = F.col("a").cast("int"), F.col("b").cast("int")
    return v.select(key, f.alias("n_for"), a.alias("n_against"), F.coalesce(F.col("c").cast("int"), F.lit(0)).alias("n_abstain"), F.when(f > a, "adopted").when(f < a, "rejected").alias("outcome"))


def bill_sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, title, body) of bills with lines 'SEC. 2. TITLE.'; what comes before has section null."""
    rows = lines(documents, key, text)
    head = r"^\s*(?:SEC(?:TION)?\.?)\s+(\d+[A-Z]?)\.\s*(.*?)\.?$"
    rows = rows.withColumn("h", F.when(F.col("line").rlike(head), F.struct(F.col("line_no").alias("at"), F.regexp_extract("line", head, 1).alias("section"), F.regexp_extract("line", head, 2).alias("title"))))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("in", F.last("h", ignorenulls=True).over(w))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("h").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, F.col("in.at").alias("at"), F.col("in.section").alias("section"), F.col("in.title").alias("title")).agg(body.alias("body")).drop("at")


def bill_changes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, kind, target, old, new): the amendments of each section and the provision it amends."""
    s = bill_sections(documents, key, text).filter("section is not null").withColumn("id", F.concat_ws("\x01", F.col(key).cast("string"), "section"))
    target = F.regexp_extract("body", r"(?i)\bsection\s+(\d+\w*(?:\([^)]+\))*)", 1)
    a = amendments(s.select("id", "body"), "id", "body")
    return a.join(s.select("id", key, "section", target.alias("target")), "id").select(key, "section", "kind", "target", "old", "new")


def affected(changes: DataFrame, references: DataFrame, target: str = "target") -> DataFrame:
    """(target, kind, n_referring): provisions that a bill amends, and how many others refer to each.

    references: (source, target). A repealed or redesignated target with referring provisions leaves them broken.
    """
    n = references.groupBy(F.col("target").alias(target)).agg(F.countDistinct("source").alias("n"))
    return changes.select(target, "kind").distinct().join(n, target, "left").select(target, "kind", F.coalesce("n", F.lit(0)).alias("n_referring"))


def rule_differences(base: DataFrame, target: DataFrame, keys: tuple[str, ...] = ("rule", "clause"), text: str = "text") -> DataFrame:
    """(keys, change, similarity, label): clauses added, removed or modified between two versions of rules."""
    a = base.select(*keys, F.col(text).alias("a"), F.lit(True).alias("in_a"))
    b = target.select(*keys, F.col(text).alias("b"), F.lit(True).alias("in_b"))
    j = a.join(b, list(keys), "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    s = word_similarity(F.col("a"), F.col("b"))
    j = j.withColumn("change", change).filter("change is not null")
    return j.select(*keys, "change", F.when(F.col("change") == "modified", s).alias("similarity"), F.when(F.col("change") == "modified", change_label(s, F.col("a"), F.col("b"))).alias("label"))


def opposed_directives(norm_rows: DataFrame, least: int = 1, shortest: int = 5) -> DataFrame:
    """(a, b, kind, n_shared): directives of two texts that share keywords: 'contradiction' with opposite polarity, 'duplicate' with the same and one keyword more.

    norm_rows: (id, side, negative, sentence), side 'a' or 'b'. Pairs meet in a join on the keyword.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("sentence"), r"[^\p{L}]+"), lambda w: F.length(w) >= shortest))
    k = norm_rows.select("id", "side", "negative", F.explode(words).alias("w"))
    a, b = (k.filter(F.col("side") == s).select(F.col("id").alias(s), F.col("negative").alias(f"n{s}"), "w") for s in "ab")
    j = a.join(b, "w").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("n_shared"))
    kind = F.when((F.col("na") != F.col("nb")) & (F.col("n_shared") >= least), "contradiction").when((F.col("na") == F.col("nb")) & (F.col("n_shared") > least), "duplicate")
    return j.withColumn("kind", kind).filter("kind is not null").select("a", "b", "kind", "n_shared")


# Phrases that make a right narrower.
NARROWING = ("except when", "except where", "except in cases", "unless", "provided that", "subject to", "limited to", "only if", "only when", "only where", "shall not apply", "does not apply", "notwithstanding", "restricted to")


def narrowed(pairs: DataFrame, keys: tuple[str, ...], before: str = "before", after: str = "after") -> DataFrame:
    """(keys, added, change): texts to which phrases that make a right narrower are 'narrowing' added, or from which all of them are gone: 'expansion'."""
    held = lambda c: F.filter(F.array(*map(F.lit, NARROWING)), lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), w))
    a, b = held(F.col(before)), held(F.col(after))
    added, gone = F.array_except(b, a), F.array_except(a, b)
    change = F.when(F.size(added) > 0, "narrowing").when(F.size(gone) > 0, "expansion")
    return pairs.select(*keys, F.array_join(F.array_sort(added), ", ").alias("added"), change.alias("change")).filter("change is not null")


def orphaned(changes: DataFrame, references: DataFrame, target: str = "target") -> DataFrame:
    """(target, source): references (source, target) that a repeal or redesignation among the changes (target, kind) leaves without what they refer to."""
    gone = changes.filter(F.col("kind").isin("repeal", "redesignate")).select(target).distinct()
    return references.select(F.col("target").alias(target), "source").distinct().join(gone, target, "left_semi")


def swimlanes(events: DataFrame, by: str, at: str = "ts") -> DataFrame:
    """Events with lane and their place in it; an array column gives an event a lane per element, null and blank lanes are left out."""
    kind = dict(events.dtypes)[by]
    lane = F.explode(F.array_distinct(by)) if kind.startswith("array") else F.col(by)
    e = events.withColumn("lane", lane).filter("trim(lane) <> ''")
    # a lane may hold most events: they are numbered within months, after what the months before hold
    e = e.withColumn("\x01m", F.date_trunc("month", F.coalesce(at, F.lit("0001-01-01").cast("timestamp"))))
    ahead = F.sum("n").over(Window.partitionBy("lane").orderBy("\x01m").rowsBetween(Window.unboundedPreceding, -1))
    before = e.groupBy("lane", "\x01m").agg(F.count(F.lit(1)).alias("n")).select("lane", "\x01m", F.coalesce(ahead, F.lit(0)).alias("\x01b"))
    within = F.row_number().over(Window.partitionBy("lane", "\x01m").orderBy(at, *[c for c in ("event_uri", "event_id") if c in events.columns]))
    return e.withColumn("\x01w", within).join(before, ["lane", "\x01m"]).withColumn("place", (F.col("\x01w") + F.col("\x01b")).cast("int")).drop("\x01m", "\x01w", "\x01b")

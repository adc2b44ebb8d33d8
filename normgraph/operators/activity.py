"""What meetings and decisions lead to: delays, missing quorum, blocked items, evolution, actions, people, links and network exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normgraph.functions.text import plain_name, slug
from normgraph.operators.extraction import lines, references, scan_patterns


def overdue(items: DataFrame, due: str, status: str, now: Column, least: int = 7, closed: Sequence[str] = ("completed", "cancelled")) -> DataFrame:
    """Items whose due date lies at least ``least`` days before ``now`` and whose status is not closed, with days_over."""
    days = F.datediff(now, F.col(due))
    return items.withColumn("days_over", days).filter((F.col("days_over") >= least) & ~F.coalesce(F.lower(F.trim(status)).isin(list(closed)), F.lit(False)))


def blocked(items: DataFrame, links: DataFrame, closed: Column) -> DataFrame:
    """(item, n_blockers): items that depend, by links (item, on), on others that are not closed; ``closed`` is a condition on items (item, ..)."""
    still = items.filter(~F.coalesce(closed, F.lit(False))).select(F.col("item").alias("on"))
    return links.dropna().distinct().join(still, "on", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n_blockers"))


def below_quorum(counts: DataFrame, present: str, quorum: Column) -> DataFrame:
    """Meetings at which fewer were present than the quorum, with the number missing."""
    return counts.withColumn("missing", quorum - F.col(present)).filter("missing > 0")


def evolution(events: DataFrame, part_of: DataFrame) -> DataFrame:
    """(chapter, kind, n, n_provisions, first_at, last_at) of proposals, amendments, adoptions and rejections.

    events: (provision, kind, at, by); part_of: (node, parent), through which a provision's chapter is found, one or two levels up.
    """
    up = part_of.groupBy("node").agg(F.min("parent").alias("parent"))
    one = events.join(up.select(F.col("node").alias("provision"), F.col("parent").alias("near")), "provision", "left")
    two = one.join(up.select(F.col("node").alias("near"), F.col("parent").alias("far")), "near", "left")
    two = two.withColumn("chapter", F.coalesce("far", "near", "provision"))
    return two.groupBy("chapter", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("provision").alias("n_provisions"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def network(pairs: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, n_votes, degree) and edges (source, target, weight) of voters who vote alike, from coalitions and profiles."""
    edges = pairs.select(F.col("voter_a").alias("source"), F.col("voter_b").alias("target"), F.col("rate").alias("weight"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return profiles.select(F.col("voter").alias("id"), "n_votes").join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), edges


_ACTION = (("action", r"(?im)^\s*action(?:\s+item)?s?\s*:\s*([^\n]+)$"),)


def actions(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, task, assignee, due, is_open): lines 'Action: who to do what by when', each task of a text once.

    The assignee is what stands before 'to' or 'shall'; the date is day, month and year after 'by'.
    """
    hits = scan_patterns(documents, _ACTION, key, text)
    task = F.trim(F.get("groups", F.lit(0)))
    due = F.coalesce(*[F.try_to_date(F.regexp_extract(task, r"(?i)\bby\s+(\d{1,2}\s+\w+\s+\d{4}|\d{4}-\d{2}-\d{2})", 1), f) for f in ("d MMMM yyyy", "yyyy-MM-dd")])
    who = F.nullif(F.trim(F.regexp_extract(task, r"^(.{2,60}?)\s+(?:to|shall|will)\s", 1)), F.lit(""))
    rows = hits.select(key, "start", task.alias("task"), who.alias("assignee"), due.alias("due"), (~F.lower(task).rlike(r"\b(done|completed|closed)\b")).alias("is_open"))
    return rows.groupBy(key, "task").agg(F.min("start").alias("start"), F.first("assignee").alias("assignee"), F.first("due").alias("due"), F.first("is_open").alias("is_open"))


def speakers(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, name, title, n): people named with a form of address at the start of a word group, how often in each text."""
    hits = scan_patterns(documents, (("person", r"\b(Mr|Ms|Mrs|Dr|Prof|Amb)\.\s+([A-Z][\w'’-]+(?:[ \t]+[A-Z][\w'’-]+){0,3})"),), key, text)
    named = hits.select(key, F.get("groups", F.lit(0)).alias("title"), plain_name(F.get("groups", F.lit(1))).alias("name"))
    return named.groupBy(key, "name", "title").agg(F.count(F.lit(1)).alias("n"))


def bodies(documents: DataFrame, kinds: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, body, n): names such as 'Council of X' or 'X Committee' of the kinds given."""
    any_kind = "|".join(kinds)
    hits = scan_patterns(documents, (("body", rf"\b(?:{any_kind})[ \t]+(?:of|for|on)[ \t]+(?:the[ \t]+)?[A-Z]\w+(?:[ \t]+[A-Z]\w+){{0,3}}"),), key, text)
    return hits.groupBy(key, F.col("matched").alias("body")).agg(F.count(F.lit(1)).alias("n"))


def linked_provisions(items: DataFrame, provisions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, identifier, uri, confidence): what agenda texts refer to; provisions: (uri, article).

    A reference to an article that one provision has is sure (1), of several 0.5; others are not listed.
    """
    refs = references(items.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").filter("target = 'article'").select("key", "identifier", F.col("levels")["article"].alias("article"))
    known = provisions.groupBy("article").agg(F.count(F.lit(1)).alias("n"), F.min("uri").alias("uri"))
    return refs.distinct().join(known, "article").select(F.col("key").alias(key), "identifier", "uri", F.when(F.col("n") == 1, 1.0).otherwise(0.5).alias("confidence"))


def roll_calls(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, voter, position) of lines 'For: A, B' or 'Against: ...' in minutes."""
    rows = lines(documents, key, text).withColumn("p", F.lower(F.regexp_extract("line", r"(?i)^(for|in favour|against|abstain(?:ed|ing)?|absent)\s*:", 1))).filter("p <> ''")
    position = F.when(F.col("p").isin("for", "in favour"), "for").when(F.col("p").startswith("abstain"), "abstain").otherwise(F.col("p"))
    voter = F.explode(F.split(F.regexp_replace("line", r"^[^:]*:\s*", ""), r"\s*[,;]\s*"))
    return rows.select(key, voter.alias("voter"), position.alias("position")).withColumn("voter", F.trim(F.regexp_replace("voter", r"\.$", ""))).filter("voter <> ''").distinct()


def node_search(labels: DataFrame, word: str, most: int = 20) -> DataFrame:
    """(s, label, rank): a top list of nodes whose label or name holds a word: equal first, then those that begin with it, then the rest by label."""
    w, label = word.lower(), F.lower("label")
    rank = F.when(label == w, 0).when(label.startswith(w), 1).otherwise(2)
    return labels.filter(label.contains(w) | F.lower("s").contains(w)).select("s", "label", rank.alias("rank")).orderBy("rank", "label", "s").limit(most)


def neighbours(triples: DataFrame, node: str) -> DataFrame:
    """(direction, p, node): what a node points at and what points at it."""
    out = triples.filter(F.col("s") == node).select(F.lit("out").alias("direction"), "p", F.col("o").alias("node"))
    return out.unionByName(triples.filter(F.col("o") == node).select(F.lit("in").alias("direction"), "p", F.col("s").alias("node"))).distinct()


def fetch_plan(refs: DataFrame, address: Column, allowed: Sequence[str], cached: DataFrame, most: int) -> DataFrame:
    """(target, address, n): what to fetch for external references (target): a top list by how often, of allowed hosts, without what is cached (target)."""
    host = F.regexp_extract("address", r"^https?://([^/:]+)", 1)
    n = refs.groupBy("target").agg(F.count(F.lit(1)).alias("n")).withColumn("address", address).filter("address is not null")
    return n.filter(host.isin(list(allowed))).join(cached.select("target").distinct(), "target", "left_anti").orderBy(F.desc("n"), "target").limit(most).select("target", "address", "n")


def definition_stats(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_definitions, n_terms, mean_length) of definitions."""
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("n_definitions"), F.countDistinct("normalized").alias("n_terms"), F.avg(F.length("definition")).alias("mean_length"))


def effective_dates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, date, start): dates from which, until which or since when something holds."""
    date = r"(\d{1,2}\s+\w+\s+\d{4}|\w+\s+\d{1,2},\s+\d{4})"
    rules = (("effective", rf"(?i)\b(?:effective(?:\s+(?:on|from|as\s+of))?|take(?:s)?\s+effect\s+on|with\s+effect\s+from)\s+{date}"), ("sunset", rf"(?i)\b(?:until|expires?\s+on|ceases?\s+to\s+have\s+effect\s+on|no\s+later\s+than)\s+{date}"), ("retroactive", rf"(?i)\b(?:retroactive(?:ly)?\s+(?:to|from)|as\s+if\s+enacted\s+on)\s+{date}"))
    hits = scan_patterns(documents, rules, key, text)
    value = F.get("groups", F.lit(0))
    return hits.select(key, F.col("rule").alias("kind"), F.coalesce(F.try_to_date(value, "d MMMM yyyy"), F.try_to_date(value, "MMMM d, yyyy")).alias("date"), "start")


def entity_uri(base: str, name: Column) -> Column:
    return F.concat(F.lit(base), slug(name))

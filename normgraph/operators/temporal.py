"""Named graphs and stored versions: graphs by name over time, a log of versions, and queries at a time or between meetings.

Both are append-only tables of which the last entry of a key holds, so that concurrent writers need no locks
and a view is one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normgraph.operators.graph import TripleGraph
from normgraph.operators.versions import changes_between, versions_at

_GRAPHS = ("name", "valid_from", "valid_until", "is_deleted")
#: Statuses of versions that hold; a superseded version holds at no time.
ACTIVE = ("active", "current", "adopted")


def graph_list(log: DataFrame) -> DataFrame:
    """(name, valid_from, valid_until) of the graphs that exist, from a log (name, valid_from, valid_until, is_deleted, at)."""
    last = log.groupBy("name").agg(F.max(F.struct("at", *_GRAPHS[1:])).alias("v")).select("name", *[f"v.{c}" for c in _GRAPHS[1:]])
    return last.filter(~F.coalesce("is_deleted", F.lit(False))).drop("is_deleted")


def graph_triples(quads: DataFrame, log: DataFrame, name: str | None = None) -> TripleGraph:
    """The triples (s, p, o) of a named graph, or of the main one (g null or empty), each once."""
    main = F.coalesce("g", F.lit("")) == ""
    rows = quads.filter(main) if name is None else quads.filter(F.col("g") == name).join(graph_list(log).select(F.col("name").alias("g")), "g", "left_semi")
    return TripleGraph(rows.select("s", "p", "o"))


def triples_at(quads: DataFrame, log: DataFrame, at: Column) -> DataFrame:
    """(s, p, o) that hold at a time: those of the main graph and of every graph that is valid then, half open; each once."""
    live = graph_list(log).filter((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (at < F.col("valid_until"))))
    named = quads.join(live.select(F.col("name").alias("g")), "g", "left_semi")
    return quads.filter(F.coalesce("g", F.lit("")) == "").select("s", "p", "o").unionByName(named.select("s", "p", "o")).distinct()


def graph_stats(quads: DataFrame, log: DataFrame) -> DataFrame:
    """(name, n_triples) of each graph that exists; the main graph's name is empty."""
    n = quads.groupBy(F.coalesce("g", F.lit("")).alias("name")).agg(F.count_distinct("s", "p", "o").alias("n"))
    names = graph_list(log).select("name").unionByName(n.filter("name = ''").select("name")).distinct()
    return names.join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_triples"))


def version_state(log: DataFrame) -> DataFrame:
    """Versions (subject, version, valid_from, valid_until, status, previous, next) from a log of what was done to them.

    log: (at, subject, version, action, value, when): 'add' with the time it holds from, 'supersede' with the version that takes over and when,
    'status' with a status, 'link' with the version before it. The last entry of each kind holds; a superseded version ends when the other begins.
    """
    last = lambda action, column: F.max_by(F.when(F.col("action") == action, F.col(column)), F.when(F.col("action") == action, F.col("at")))
    v = log.groupBy("subject", "version").agg(last("add", "when").alias("valid_from"), last("supersede", "when").alias("valid_until"), last("supersede", "value").alias("next"), last("status", "value").alias("given"), last("link", "value").alias("previous"))
    status = F.when(F.col("next").isNotNull(), "superseded").otherwise(F.coalesce("given", F.lit("active")))
    return v.filter("valid_from is not null").select("subject", "version", "valid_from", "valid_until", status.alias("status"), "previous", "next")


def in_force(versions: DataFrame, at: Column, statuses: Sequence[str] = ACTIVE) -> DataFrame:
    """The version in force of each subject at a time: of an active status, half open, the latest begun."""
    return versions_at(versions.filter(F.col("status").isin(list(statuses))), at)


def changed_bindings(rows: DataFrame, versions: DataFrame, after: Column, until: Column, columns: Sequence[str]) -> DataFrame:
    """(subject, version, at, change, previous): changes in (after, until] of all versioned values that a query's rows hold."""
    values = rows.select(F.explode(F.array_distinct(F.array(*columns))).alias("subject")).distinct()
    return changes_between(versions.join(values, "subject", "left_semi"), after, until)


def changes_between_meetings(versions: DataFrame, meetings: DataFrame, first: str, second: str) -> DataFrame:
    """Changes after one meeting up to another, both named by uri; meetings: (uri, meeting_date), the last date of a uri counts."""
    dates = meetings.filter(F.col("uri").isin(first, second)).agg(F.max(F.when(F.col("uri") == first, F.col("meeting_date"))).alias("\x01a"), F.max(F.when(F.col("uri") == second, F.col("meeting_date"))).alias("\x01b"))
    return changes_between(versions.crossJoin(F.broadcast(dates)), F.col("\x01a"), F.col("\x01b"))  # one row


def adopted_between(decisions: DataFrame, after: Column, until: Column, kind: str = "amendment") -> DataFrame:
    """(uri, title, decided_at): decisions of a kind (case ignored) with a date in (after, until], each uri at its last date."""
    d = decisions.filter((F.lower(F.trim("decision_type")) == kind) & (F.col("decided_at") > after) & (F.col("decided_at") <= until))
    return d.groupBy(F.lower(F.trim("uri")).alias("uri")).agg(F.max(F.struct("decided_at", "title")).alias("d")).filter("uri is not null").select("uri", "d.title", "d.decided_at")


def temporal_stats(versions: DataFrame) -> DataFrame:
    """(status, n_versions, n_subjects, first_from, last_from)."""
    return versions.groupBy("status").agg(F.count(F.lit(1)).alias("n_versions"), F.countDistinct("subject").alias("n_subjects"), F.min("valid_from").alias("first_from"), F.max("valid_from").alias("last_from"))

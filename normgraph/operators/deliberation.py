"""Meetings over time: agenda topics, deferrals, inactivity, differences between meetings, event chains, participation.

Thresholds are parameters; what a state means is the caller's.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normgraph.operators.documents import keyed_diff


def last_versions(rows: DataFrame, key: str, at: str = "recorded_at", deleted: str = "is_deleted") -> DataFrame:
    """The last version of each key (trimmed, lower case), left out if it is deleted; ties go to the larger row."""
    rows = rows.withColumn(key, F.lower(F.trim(key))).filter(F.col(key).isNotNull())
    others = [c for c in rows.columns if c not in (key, at)]
    last = rows.groupBy(key).agg(F.max(F.struct(at, *others)).alias("v")).select(key, "v.*")
    return last.filter(~F.coalesce(deleted, F.lit(False)))


def agenda(meetings: DataFrame) -> DataFrame:
    """(series, meeting, place, topic, outcome): the agenda of each meeting's last version; place numbers the meetings of a series by date."""
    m = last_versions(meetings, "uri")
    m = m.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy("meeting_date", "uri")))
    items = m.select("series", F.col("uri").alias("meeting"), "place", F.explode("agenda_items").alias("i"))
    return items.select("series", "meeting", "place", F.lower(F.trim("i.title")).alias("topic"), "i.outcome").filter("topic <> ''")


def deferrals(items: DataFrame, least: int = 2, outcome: str = "deferred") -> DataFrame:
    """(series, topic, n, first_place, last_place): topics put off at least so often."""
    d = items.filter(F.col("outcome") == outcome).groupBy("series", "topic")
    return d.agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"), F.max("place").alias("last_place")).filter(F.col("n") >= least)


def inactive(items: DataFrame, meetings: int = 3, closed: tuple[str, ...] = ("decided", "withdrawn")) -> DataFrame:
    """(series, topic, last_place, since): topics not on the agenda of a series' last meetings and not closed when last there."""
    t = items.groupBy("series", "topic").agg(F.max("place").alias("last_place"), F.max_by("outcome", F.struct("place", "outcome")).alias("outcome"))
    ends = items.groupBy("series").agg(F.max("place").alias("end"))
    out = t.join(ends, "series").withColumn("since", F.col("end") - F.col("last_place"))
    return out.filter((F.col("since") >= meetings) & ~F.coalesce(F.col("outcome").isin(list(closed)), F.lit(False))).select("series", "topic", "last_place", "since")


def meeting_differences(items: DataFrame) -> DataFrame:
    """(series, place, topic, change, before, after): outcomes of topics against the meeting before in the series."""
    at = items.groupBy("series", "place", "topic").agg(F.max("outcome").alias("outcome"))
    last = at.groupBy("series").agg(F.max("place").alias("end"))
    before = at.join(last, "series").filter(F.col("place") < F.col("end")).select("series", (F.col("place") + 1).alias("place"), "topic", "outcome")
    return keyed_diff(before, at.filter("place > 1"), ["series", "place", "topic"], "outcome")


def event_chains(events: DataFrame, states: Mapping[str, str], subject: str = "subject", at: str = "at", kind: str = "kind") -> DataFrame:
    """(subject, step, at, kind, state): events of a subject in order, repeats of a kind at one time once, with the state after each.

    ``states`` gives the state a kind of event leads to; other kinds leave it as it is.
    """
    e = events.select(F.col(subject).alias("subject"), F.col(at).alias("at"), F.col(kind).alias("kind")).dropna().distinct()
    to = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])[F.col("kind")]
    w = Window.partitionBy("subject").orderBy("at", "kind")
    return e.select("subject", F.row_number().over(w).alias("step"), "at", "kind", F.last(to, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("state"))


def chain_statistics(chains: DataFrame) -> DataFrame:
    """(subject, n_steps, first_kind, last_kind, state, days)."""
    first, last = F.min_by("kind", "step"), F.max_by("kind", "step")
    return chains.groupBy("subject").agg(F.count(F.lit(1)).alias("n_steps"), first.alias("first_kind"), last.alias("last_kind"), F.max_by("state", "step").alias("state"), F.datediff(F.max("at"), F.min("at")).alias("days"))


def participation(events: DataFrame, actors: str = "actors", at: str = "ts") -> DataFrame:
    """(actor, period, n_events, n_kinds) of each actor and year."""
    e = events.select(F.explode(F.array_distinct(actors)).alias("actor"), F.year(at).alias("period"), "event_type").filter("trim(actor) <> ''")
    return e.groupBy("actor", "period").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_type").alias("n_kinds"))

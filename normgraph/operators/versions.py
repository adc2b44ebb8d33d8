"""Versions of provisions over time: as-of and between queries, timelines, durations and comparisons.

Versions are rows (subject, version, valid_from, valid_until, status). A version
holds in [valid_from, valid_until), without end where valid_until is null;
'superseded' ones hold at no time when ``status`` decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def version_history(changes: DataFrame, subject: str, at: str, tie: str) -> DataFrame:
    """Versions from a log of changes: numbered in order of ``at`` (ties by ``tie``), each valid until the next."""
    w = Window.partitionBy(subject).orderBy(at, tie)
    until = F.lead(at).over(w)
    return changes.select(F.col(subject).alias("subject"), F.row_number().over(w).cast("bigint").alias("version"), F.col(at).alias("valid_from"), until.alias("valid_until"), F.when(until.isNull(), "active").otherwise("superseded").alias("status"))


def _holds(at: Column) -> Column:
    return (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (at < F.col("valid_until")))


def versions_at(versions: DataFrame, at: Column) -> DataFrame:
    """The version of each subject that holds at a time, the latest by valid_from if several do."""
    return versions.filter(_holds(at)).groupBy("subject").agg(F.max(F.struct("valid_from", "version", "valid_until", "status")).alias("v")).select("subject", "v.version", "v.valid_from", "v.valid_until", "v.status")


def as_of(rows: DataFrame, versions: DataFrame, at: Column, columns: Sequence[str]) -> DataFrame:
    """Rows whose versioned values all hold at a time; values without versions always hold."""
    held = versions_at(versions, at).select("subject").withColumn("holds", F.lit(True))
    known = versions.select("subject").distinct().join(held, "subject", "left")
    for c in columns:
        k = known.select(F.col("subject").alias(c), F.lit(True).alias("known"), "holds")
        rows = rows.join(k, c, "left").filter("known is null or holds").drop("known", "holds")
    return rows


def as_of_join(events: DataFrame, versions: DataFrame, subject: str, at: str, chunk: str = "month") -> DataFrame:
    """Each event with the version of its subject at its time and its valid_from, nulls without one.

    Where several versions hold, the latest by valid_from, then by number. Subjects whose versions do not overlap,
    the usual case, need no join: versions and events stand in one order of time, and the last version begun is
    carried to the events after it, in chunks of time, so that a subject with very many events takes many tasks. For
    other subjects, events join the versions that hold.
    """
    v = versions.select(F.col("subject").cast("string").alias("\x01s"), "version", "valid_from", "valid_until").filter("valid_from is not null")
    nxt = F.lead("valid_from").over(Window.partitionBy("\x01s").orderBy("valid_from", "version"))
    meets = nxt.isNotNull() & (F.col("valid_until").isNull() | (F.col("valid_until") > nxt))
    tangled = v.withColumn("meets", meets).filter("meets").select("\x01s").distinct()
    e = events.withColumn("\x01s", F.col(subject).cast("string"))
    simple, rest = e.join(tangled, "\x01s", "left_anti"), e.join(tangled, "\x01s", "left_semi")

    held = F.struct("version", "valid_from", "valid_until").alias("\x01v")
    row = F.struct(*events.columns).alias("\x01e")
    begun = v.join(tangled, "\x01s", "left_anti").select("\x01s", F.col("valid_from").alias("\x01t"), F.lit(0).alias("\x01k"), held).withColumn("\x01e", F.lit(None).cast(simple.select(row).schema[0].dataType))
    asked = simple.select("\x01s", F.col(at).alias("\x01t"), F.lit(1).alias("\x01k"), F.lit(None).cast(begun.schema["\x01v"].dataType).alias("\x01v"), row)
    line = begun.unionByName(asked).withColumn("\x01c", F.date_trunc(chunk, F.coalesce("\x01t", F.lit("0001-01-01").cast("timestamp"))))
    last = line.filter("`\x01k` = 0").groupBy("\x01s", "\x01c").agg(F.max("\x01v.valid_from").alias("f"), F.max_by("\x01v", F.struct("\x01v.valid_from", "\x01v.version")).alias("\x01b"))
    chunks = line.select("\x01s", "\x01c").distinct().join(last, ["\x01s", "\x01c"], "left")
    order = Window.partitionBy("\x01s").orderBy("\x01c").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("\x01s", "\x01c", F.last("\x01b", ignorenulls=True).over(order).alias("\x01p"))
    w = Window.partitionBy("\x01s", "\x01c").orderBy("\x01t", "\x01k", F.col("\x01v.version")).rowsBetween(Window.unboundedPreceding, 0)
    run = line.withColumn("\x01n", F.last("\x01v", ignorenulls=True).over(w)).filter("`\x01k` = 1").join(carried, ["\x01s", "\x01c"], "left")
    run = run.withColumn("\x01n", F.coalesce("\x01n", "\x01p"))
    holds = F.col("\x01t").isNotNull() & (F.col("\x01n.valid_until").isNull() | (F.col("\x01t") < F.col("\x01n.valid_until")))
    fine = run.select("\x01e.*", *[F.when(holds, F.col(f"\x01n.{c}")).alias(c) for c in ("version", "valid_from")])
    # a null subject has no versions and is not in the order above
    none = e.filter("`\x01s` is null").drop("\x01s").withColumns({c: F.lit(None).cast(versions.schema[c].dataType) for c in ("version", "valid_from")})
    fine = fine.filter(F.col(subject).isNotNull()).unionByName(none)

    on = (rest["\x01s"] == v["\x01s"]) & (F.col("valid_from") <= F.col(at)) & (F.col("valid_until").isNull() | (F.col(at) < F.col("valid_until")))
    j = rest.withColumn("\x01id", F.monotonically_increasing_id()).join(v, on, "left")
    best = j.groupBy("\x01id", *events.columns).agg(F.max(F.struct("valid_from", "version")).alias("\x01b"))
    return fine.unionByName(best.select(*events.columns, F.col("\x01b.version").alias("version"), F.col("\x01b.valid_from").alias("valid_from")))


def changes_between(versions: DataFrame, after: Column, until: Column) -> DataFrame:
    """(subject, version, at, change, previous): versions that begin in (after, until]; a subject's first is 'added'."""
    w = Window.partitionBy("subject").orderBy("valid_from", "version")
    v = versions.withColumn("previous", F.lag("version").over(w))
    v = v.filter((F.col("valid_from") > after) & (F.col("valid_from") <= until))
    return v.select("subject", "version", F.col("valid_from").alias("at"), F.when(F.col("previous").isNull(), "added").otherwise("modified").alias("change"), "previous")


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("n_subjects"))


def timeline(events: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(subject, at, kind) of several tables (frame, subject, time, kind), for one ordered view."""
    out = None
    for df, subject, at, kind in events:
        part = df.select(F.col(subject).alias("subject"), F.col(at).alias("at"), F.lit(kind).alias("kind")).filter("at is not null")
        out = part if out is None else out.unionByName(part)
    return out


def timeline_span(events: DataFrame) -> DataFrame:
    """(subject, first_at, last_at, n_events, span_seconds)."""
    return events.groupBy("subject").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n_events")).withColumn("span_seconds", F.timestamp_diff("SECOND", "first_at", "last_at"))


def durations(versions: DataFrame) -> DataFrame:
    """(subject, proposed_at, adopted_at, seconds): the first version to the first active one, where that is later."""
    d = versions.groupBy("subject").agg(F.min("valid_from").alias("proposed_at"), F.min(F.when(F.col("status") == "active", F.col("valid_from"))).alias("adopted_at"))
    return d.filter("adopted_at > proposed_at").withColumn("seconds", F.timestamp_diff("SECOND", "proposed_at", "adopted_at"))


def mean_duration(versions: DataFrame) -> DataFrame:
    """One row: the mean seconds from proposal to adoption, and of how many subjects."""
    return durations(versions).agg(F.avg("seconds").alias("mean_seconds"), F.count(F.lit(1)).alias("n"))


def compare_versions(triples: DataFrame, a: str, b: str) -> DataFrame:
    """(p, change, old, new) between two version subjects; of several values of a predicate the largest counts."""
    t = triples.filter(F.col("s").isin(a, b)).groupBy("p").agg(F.max(F.when(F.col("s") == a, F.col("o"))).alias("old"), F.max(F.when(F.col("s") == b, F.col("o"))).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return t.withColumn("change", change).filter("change is not null").select("p", "change", "old", "new")


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], bounds: tuple[str, str] = ("start_date", "end_date"), crowd: int = 2000) -> DataFrame:
    """Pairs of closed ranges of the same keys that overlap; a null end is open. Columns of ``b`` get the prefix b_.

    Ranges of ``a`` of a key with more than ``crowd`` of them spread over several tasks, to each of which those of ``b`` are copied.
    """
    s, e = bounds
    parts = a.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("\x01n")).filter(F.col("\x01n") > 1)
    spread = lambda df, part: df.join(parts, list(keys), "left").withColumn("\x01p", part).drop("\x01n")
    n = F.coalesce(F.col("\x01n"), F.lit(1))
    left = spread(a, F.pmod(F.xxhash64(*a.columns), n).cast("int"))
    right = spread(b, F.explode(F.sequence(F.lit(0), n - 1))).withColumnsRenamed({c: f"b_{c}" for c in b.columns} | {"\x01p": "\x01q"})
    on = left["\x01p"] == right["\x01q"]
    for k in keys:
        on = on & (left[k] == right[f"b_{k}"])
    open_end = F.lit("9999-12-31").cast("date")
    both = left.join(right, on & (F.col(s) <= F.coalesce(F.col(f"b_{e}"), open_end)) & (F.col(f"b_{s}") <= F.coalesce(F.col(e), open_end)))
    return both.select(*a.columns, *[f"b_{c}" for c in b.columns])

"""References to records that do not exist.

Keys are dictionary-encoded as integers within hash ranges of the key space.
Each range gets, per period (month), a compressed bitmap of the keys referred
to and one of the parents that exist by then; references AND NOT parents leaves
the bits of suspects, which are decoded to keys and joined back to their rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.operators.bitmaps import CompressedBitmap
from normgraph.staging import buckets_for, hot_split_join, stage

_NEVER = 2**31 - 1  # period of a reference whose time is unknown: after every parent
_SUSPECT = "ns string, key string, period int, n long, state string, first_at timestamp_ntz"


def _month(at):
    return (F.year(at) * 12 + F.month(at)).cast("int")


def _suspects(table: pa.Table) -> pa.Table:
    """Suspect (namespace, key, period) of one key range: reference AND NOT parent, by period."""
    name = pc.binary_join_element_wise(table["ns"], table["key"], "\x01")
    codes = np.asarray(name.combine_chunks().dictionary_encode().indices)
    is_ref = np.asarray(table["is_ref"])
    period = np.asarray(table["period"])
    gone = np.asarray(table["gone"])
    refs, parents = np.flatnonzero(is_ref), np.flatnonzero(~is_ref)

    # parents by the period they first appear in; deleted ones never count
    live = parents[~gone[parents]]
    live = live[np.argsort(period[live], kind="stable")]
    first_period = period[live]
    order = refs[np.argsort(period[refs], kind="stable")]
    existing, seen, rows = CompressedBitmap(), 0, []
    cuts = np.flatnonzero(np.diff(period[order])) + 1
    for chunk in np.split(order, cuts) if len(order) else []:
        upto = int(np.searchsorted(first_period, period[chunk[0]], side="left"))
        if upto > seen:
            existing.update(CompressedBitmap(codes[live[seen:upto]]))
            seen = upto
        left = CompressedBitmap(codes[chunk]).and_not(existing).decode()
        if len(left):
            rows.append(chunk[np.isin(codes[chunk], left)])
    rows = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)

    parent_row = np.full(int(codes.max()) + 1 if len(codes) else 1, -1, dtype=np.int64)
    parent_row[codes[parents]] = parents
    at = parent_row[codes[rows]] if len(rows) else np.empty(0, dtype=np.int64)
    state = np.where(at < 0, "missing", np.where(gone[at], "deleted", "late")) if len(rows) else np.empty(0, dtype=object)
    take = table.take(pa.array(rows))
    first = table["first_at"].combine_chunks().take(pa.array(np.where(at < 0, 0, at), mask=at < 0))
    return pa.table({"ns": take["ns"], "key": take["key"], "period": take["period"], "n": take["n"], "state": pa.array(state.astype(object), pa.string()), "first_at": first})


def orphan_references(refs: DataFrame, targets: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """Rows of ``refs`` whose reference fails, with the reason.

    refs: (ref_table, ref_field, row_id, ns, key, recorded_at); targets, unique
    on (ns, key): (ns, key, first_at, gone). ``ns`` separates key spaces.

    Returns ref_table, ref_field, row_id, key, recorded_at, reason, with reason
    'missing' (no such target), 'deleted' (``gone``) or 'late' (first_at after
    the row's recorded_at). Rows with a null key refer to nothing and never
    fail. A row without recorded_at fails only by 'missing' or 'deleted'; a
    target without first_at counts as there from the start. Repeated rows of
    ``refs`` each come out. Empty inputs give an empty result.

    Hot keys: references collapse to one row per key and period before the
    shuffle, and the way back broadcasts the at most 1,000 keys that hold more
    than a thousandth of all rows each.
    """
    refs = refs.filter(F.col("key").isNotNull())
    period = F.coalesce(_month(F.col("recorded_at")), F.lit(_NEVER))
    asked = refs.groupBy("ns", "key", period.alias("period")).agg(F.count("*").alias("n"))
    there = targets.filter(F.col("key").isNotNull()).select("ns", "key", F.coalesce(_month(F.col("first_at")), F.lit(0)).alias("period"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("is_ref"), F.coalesce("gone", F.lit(False)).alias("gone"), F.col("first_at").cast("timestamp_ntz").alias("first_at"))
    both = asked.select("ns", "key", "period", "n", F.lit(True).alias("is_ref"), F.lit(False).alias("gone"), F.lit(None).cast("timestamp_ntz").alias("first_at")).unionByName(there)

    total = refs.count()
    ranges = buckets_for(total, rows_per_range, int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    suspects = both.withColumn("range", F.pmod(F.xxhash64("ns", "key"), F.lit(ranges))).groupBy("range").applyInArrow(lambda t: _suspects(t), _SUSPECT)
    suspects = stage(suspects, "suspects")

    rows = refs.withColumn("period", period)
    hit = hot_split_join(rows, suspects, ["ns", "key", "period"], "n", hot_rows=max(1000, total // 1000))
    failed = (F.col("state") != "late") | (F.col("first_at") > F.col("recorded_at"))
    return hit.filter(failed).select("ref_table", "ref_field", "row_id", "key", "recorded_at", F.col("state").alias("reason"))


def _uri(c):
    """Trimmed and lower-cased URI; null where the value is no reference."""
    u = F.lower(F.trim(c))
    return F.when(u.startswith("urn:") | u.startswith("https:"), u)


def _citation(c):
    """Comparable form of a citation; null for a null or blank text."""
    s = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    for prefix in ("urn:external:", "directive:", "regulation:"):
        s = F.regexp_replace(s, f"^{prefix}", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.regexp_replace(c, r"\s+", "") != "", s)


def _latest(rows: DataFrame, key: str, *carry: str) -> DataFrame:
    """First time and last state per key; ties in time go to the deleted, then the larger row."""
    order = F.struct("recorded_at", "gone", *carry)
    return rows.groupBy(key).agg(F.min("recorded_at").alias("first_at"), F.max(order).alias("last"))


def deliberation_references(meetings: DataFrame, decisions: DataFrame, external_refs: DataFrame, instruments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and targets of the deliberation tables, for :func:`orphan_references`.

    Every row's references count, repeated and deleted ones too. Agenda items
    are those of any version of a meeting; an item is gone unless the latest row
    of a meeting, not deleted, lists it. Nulls in keys refer to nothing.
    """
    gone = F.coalesce("is_deleted", F.lit(False)).alias("gone")
    m = meetings.select(F.lower(F.trim("uri")).alias("key"), "recorded_at", gone, F.transform(F.coalesce("agenda_items", F.array()), lambda x: F.lower(F.trim(x["uri"]))).alias("items")).filter("key is not null")
    last = _latest(m, "key", "items")
    items = m.select("recorded_at", F.explode("items").alias("key")).filter("key is not null").groupBy("key").agg(F.min("recorded_at").alias("first_at"))
    kept = last.filter(~F.col("last.gone")).select(F.explode("last.items").alias("key")).filter("key is not null").distinct().withColumn("kept", F.lit(True))
    d = decisions.select(F.lower(F.trim("uri")).alias("key"), "recorded_at", gone).filter("key is not null")
    i = instruments.select(_citation(F.col("citation")).alias("key"), "recorded_at", gone).filter("key is not null")
    targets = last.select(F.lit("meeting").alias("ns"), "key", "first_at", F.col("last.gone").alias("gone"))
    targets = targets.unionByName(items.join(kept, "key", "left").select(F.lit("item").alias("ns"), "key", "first_at", F.col("kept").isNull().alias("gone")))
    for ns, rows in (("decision", d), ("instrument", i)):
        targets = targets.unionByName(_latest(rows, "key").select(F.lit(ns).alias("ns"), "key", "first_at", F.col("last.gone").alias("gone")))

    fields = (("meeting_uri", "meeting"), ("agenda_item_uri", "item"), ("supersedes_uri", "decision"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(ns).alias("ns"), _uri(F.col(f)).alias("key")) for f, ns in fields])).alias("r")
    refs = decisions.select(F.lit("decisions").alias("ref_table"), "row_id", "recorded_at", each).select("ref_table", "r.ref_field", "row_id", "r.ns", "r.key", "recorded_at")
    ext = external_refs.select(F.lit("external_refs").alias("ref_table"), F.lit("ref_text").alias("ref_field"), "row_id", F.lit("instrument").alias("ns"), _citation(F.col("ref_text")).alias("key"), "recorded_at")
    return refs.unionByName(ext).filter("key is not null"), targets


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def failed_references(spark: SparkSession, d: str) -> DataFrame:
    refs, targets = deliberation_references(*(_read(spark, d, n) for n in ("meetings", "decisions", "external_refs", "instruments")))
    return orphan_references(refs, targets)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return failed_references(spark, d).select("ref_table", "ref_field", "row_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Failed references per table, field, month of recorded_at and reason."""
    month = F.date_format("recorded_at", "yyyy-MM")
    return failed_references(spark, d).groupBy("ref_table", "ref_field", month.alias("month"), "reason").agg(F.count("*").alias("n_failed"))

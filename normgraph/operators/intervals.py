"""Overlapping and gapped time intervals: merged periods and the gaps between them.

The aggregate's state is a sorted list of disjoint, non-touching day intervals.
States merge by one linear pass, in a reduction tree: within an Arrow batch,
within a slice of a key, within the key. A state is bounded by the calendar:
disjoint intervals that do not touch number at most half the days of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN_DAY = 2932896  # 9999-12-31 as days since 1970-01-01


def merge_sorted(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint periods of intervals sorted by (group, start); groups are ascending integers.

    Ends are inclusive; an interval that begins by the day after an end continues it.
    """
    if not len(group):
        return group, start, end
    span = np.int64(1) << 33
    reach = np.maximum.accumulate(group * span + (end + (span >> 1)))  # a later group always exceeds an earlier one
    fresh = np.ones(len(group), dtype=bool)
    fresh[1:] = group[1:] * span + (start[1:] + (span >> 1)) > reach[:-1] + 1
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(group)) - 1
    return group[heads], start[heads], reach[tails] - (span >> 1) - group[heads] * span


def _key_changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True where a row's keys differ from those of the row before."""
    n = table.num_rows
    out = np.zeros(n, dtype=bool)
    out[:1] = True
    for k in keys:
        c = table[k].combine_chunks()
        if n > 1:
            out[1:] |= np.asarray(pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True))
    return out


def _states(table: pa.Table, keys: Sequence[str], head: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """One row per group: its keys, taken from row ``head[group]``, and its lists."""
    offsets = pa.array(np.append(np.searchsorted(group, np.arange(len(head))), len(group)).astype(np.int32))
    at = table.select(list(keys)).take(pa.array(head))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (start, end)]
    return pa.table([*at.columns, *lists], names=[*keys, "starts", "ends"])


def _batch_states(keys: Sequence[str]):
    """Leaves of the tree: the states of one Arrow batch of single intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).sort_by([*((k, "ascending") for k in keys), ("s", "ascending")])
            changes = _key_changes(t, keys)
            group, start, end = merge_sorted(np.cumsum(changes) - 1, np.asarray(t["s"], dtype=np.int64), np.asarray(t["e"], dtype=np.int64))
            yield from _states(t, keys, np.flatnonzero(changes), group, start, end).to_batches()

    return run


def _merge_states(keys: Sequence[str]):
    """Inner nodes: states sorted by key merge, one batch at a time, the last key carried on."""

    def merged(t: pa.Table) -> pa.Table:
        changes = _key_changes(t, keys)
        group = np.cumsum(changes) - 1
        lens = np.asarray(pc.list_value_length(t["starts"].combine_chunks()))
        flat = np.repeat(group, lens)
        start, end = (np.asarray(pc.list_flatten(t[c].combine_chunks()), dtype=np.int64) for c in ("starts", "ends"))
        order = np.lexsort((start, flat))
        return _states(t, keys, np.flatnonzero(changes), *merge_sorted(flat[order], start[order], end[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).select([*keys, "starts", "ends"])
            for c in ("starts", "ends"):
                t = t.set_column(t.schema.get_field_index(c), c, t[c].cast(pa.list_(pa.int32())))
            t = merged(pa.concat_tables([held, t]) if held is not None else t)
            yield from t.slice(0, t.num_rows - 1).to_batches()
            held = t.slice(t.num_rows - 1)
        if held is not None:
            yield from held.to_batches()

    return run


def interval_lists(df: DataFrame, keys: Sequence[str], start: str, end: str, slices: int = 16) -> DataFrame:
    """One row per key: ``starts`` and ``ends``, the days (since 1970) of its continuous periods.

    ``start`` and ``end`` are dates, both inclusive. Rows with a null key, a
    null start or an end before the start are ignored; a null end, or
    9999-12-31, is open. Repeated and tied rows do not change the result. Only
    the named columns are read. An empty input gives an empty result.

    A hot key is merged map-side first, then in ``slices`` independent parts.
    """
    keys = list(keys)
    days = [F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) for c in (start, end)]
    rows = df.select(*keys, days[0].alias("s"), F.coalesce(days[1], F.lit(OPEN_DAY)).alias("e")).filter(F.col("s").isNotNull() & (F.col("e") >= F.col("s")))
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    schema = f"{types}, starts array<int>, ends array<int>"
    leaves = rows.mapInArrow(_batch_states(keys), schema).withColumn("slice", F.pmod(F.xxhash64(F.spark_partition_id(), F.col("starts")[0]), F.lit(slices)).cast("int"))
    inner = leaves.repartition(*keys, "slice").sortWithinPartitions(*keys, "slice").mapInArrow(_merge_states([*keys, "slice"]), f"{types}, slice int, starts array<int>, ends array<int>")
    return inner.drop("slice").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge_states(keys), schema)


def _text(day):
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")


def periods_and_gaps(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, kind, from_date, to_date) of :func:`interval_lists`: its periods and their complement.

    Dates are YYYY-MM-DD, both ends inclusive; an open end is 'open'.
    """
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    held = F.transform(F.arrays_zip("starts", "ends"), lambda x: row("period", x["starts"], x["ends"]))
    free = F.transform(F.arrays_zip(F.slice("starts", F.lit(2), F.size("starts") - 1).alias("starts"), F.slice("ends", F.lit(1), F.size("ends") - 1).alias("ends")), lambda x: row("gap", x["ends"] + 1, x["starts"] - 1))
    each = lists.select(*keys, F.explode(F.concat(held, free)).alias("x"))
    until = F.when(F.col("x.b") == OPEN_DAY, "open").otherwise(_text(F.col("x.b")))
    return each.select(*keys, "x.kind", _text(F.col("x.a")).alias("from_date"), until.alias("to_date"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/role_assignments.parquet").withColumn("role", F.lower(F.trim("role")))
    return periods_and_gaps(interval_lists(rows, ["speaker_uri", "role"], "start_date", "end_date"), ["speaker_uri", "role"])

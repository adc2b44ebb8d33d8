"""Watching sources of documents with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch_files(spark: SparkSession, path: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """Stream of new files: (path, modified_at, size, checksum, content)."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return raw.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"), "content")


def watch_table(spark: SparkSession, path: str, schema, form: str = "parquet", glob: str = "*", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).format(form).load(path)


def filter_documents(docs: DataFrame, title_contains: str | None = None, title_regex: str | None = None, category: str | None = None, since: str | None = None, until: str | None = None, at: str = "published_at", youngest: str | None = None, oldest: str | None = None) -> DataFrame:
    """Documents that pass all given filters; a null never passes one that looks at it.

    ``youngest`` and ``oldest`` are ages, as '2 days', that a document must have reached, or not exceeded, when it is looked at.
    """
    for given, test in (
        (title_contains, lambda v: F.lower("title").contains(v.lower())), (title_regex, lambda v: F.col("title").rlike(v)), (category, lambda v: F.col("category") == v),
        (youngest, lambda v: F.col(at) <= F.current_timestamp() - F.expr(f"interval {v}")), (oldest, lambda v: F.col(at) >= F.current_timestamp() - F.expr(f"interval {v}")),
        (since, lambda v: F.col(at) >= F.lit(v).cast("timestamp")), (until, lambda v: F.col(at) < F.lit(v).cast("timestamp")),
    ):
        if given is not None:
            docs = docs.filter(test(given))
    return docs


def first_seen(docs: DataFrame, key: str = "url", at: str = "published_at", within: str = "30 days") -> DataFrame:
    """Each key once: later arrivals within the time are dropped, and state older than it is freed."""
    return docs.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def changed(docs: DataFrame, key: str = "path", checksum: str = "checksum") -> DataFrame:
    """(key, checksum, change): each first or changed version of a key, by the checksum last seen of it.

    State is one checksum per key, kept in the state store, so a restart goes on where it stopped.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = (state.get[0], True) if state.exists else (None, False)
        out = []
        for frame in frames:
            for c in frame[checksum]:
                if not seen or c != last:
                    out.append((k[0], c, "modified" if seen else "new"))
                last, seen = c, True
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, checksum, "change"])

    return docs.select(key, checksum).groupBy(key).applyInPandasWithState(step, f"{key} string, {checksum} string, change string", "last string", "append", GroupStateTimeout.NoTimeout)


def deleted(known: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """(key): keys of a state seen before that a listing no longer has."""
    return known.select(key).distinct().join(now.select(key), key, "left_anti")


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, by, n) per window of event time; rows later than ``late`` no longer count."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", form: str = "parquet") -> StreamingQuery:
    """Process what is there and stop; the next call goes on after it."""
    q = stream.writeStream.format(form).outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_updates(stream: DataFrame, out: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Process what is there and return the last state of each key of an aggregating stream.

    Each batch writes only the keys that changed to a folder of its own, so nothing is gathered on the driver
    and a repeated batch replaces itself. Rows later than the stream's watermark no longer count.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    written = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(out)
    return written.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("last")).select(*keys, *[f"last.{c}" for c in values])


def watch_and_ingest(stream: DataFrame, library, to_triples, checkpoint: str) -> StreamingQuery:
    """Add the triples of each batch of documents to a library; a repeated batch only replaces the same documents."""

    def add(batch: DataFrame, _: int) -> None:
        triples = to_triples(batch)
        if triples.take(1):
            library.add(triples)

    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q

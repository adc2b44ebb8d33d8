"""Cutting lineage and joining skewed keys: helpers shared by the operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
every executor shares, so that a lost executor costs a re-read and no
recomputation. Where that setting is absent, a local session (tests, notebooks)
gets a temporary folder of its machine; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as the session names it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="normgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there when the driver's JVM ends is deleted."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, target = _file_system(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


class Staged:
    """A table written to the shared folder; ``df`` reads it, ``drop()`` deletes it.

    ``observed`` are aggregates over its rows, computed while it is written; ``seen`` holds their values.
    """

    def __init__(self, df: DataFrame, name: str = "stage", **observed: Column):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, name)
        schema = df.schema
        watch = Observation() if observed else None
        if watch:
            df = df.observe(watch, *[c.alias(k) for k, c in observed.items()])
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path)
        self.seen = watch.get if watch else {}
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        fs, target = _file_system(self.spark, self.path)
        fs.delete(target, True)
        fs.cancelDeleteOnExit(target)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back. It is removed when the driver ends."""
    return Staged(df, name).df


def buckets_for(rows: int, per_bucket: int, least: int = 1) -> int:
    """Number of hash buckets that keeps a bucket near ``per_bucket`` rows."""
    return max(least, -(-rows // per_bucket))


def hot_split_join(big: DataFrame, small: DataFrame, on: Sequence[str], weight: str, hot_rows: int, small_limit: int = 20_000, n_hot: int | None = None) -> DataFrame:
    """Inner join of a skewed ``big`` with ``small``, which is unique on ``on``.

    ``small[weight]`` holds how many rows of ``big`` have the key. Keys over
    ``hot_rows`` are broadcast: their number is at most rows(big) / hot_rows,
    which the caller bounds by its choice of ``hot_rows`` and ``small_limit``
    enforces. All other keys go through a shuffle join in which no key exceeds
    ``hot_rows`` rows. Keys must not be null. ``n_hot`` is the number of keys
    over ``hot_rows`` where the caller knows it.
    """
    on = list(on)
    hot = small.filter(F.col(weight) > hot_rows)
    n_hot = hot.count() if n_hot is None else n_hot
    if n_hot == 0:
        return big.join(small, on)
    if n_hot > small_limit:
        raise ValueError(f"{n_hot} keys over {hot_rows} rows: choose a larger hot_rows")
    cold = small.filter(F.col(weight) <= hot_rows)
    first = big.join(F.broadcast(hot), on)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return first.unionByName(rest)
